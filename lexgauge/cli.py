"""Command line: ``run`` collects answers, ``rules`` evaluates a result file, ``aggregate`` reports on a result tree."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lexgauge.functions.rules import RULE_COLUMNS, RuleConfig, as_cells, apply_rules
from lexgauge.operators.inputs import VARIANTS, ValidationError, require_columns
from lexgauge.plans.collect import Choice, Run, collect
from lexgauge.plans.reports import report_tables, summary_document
from lexgauge.sinks.reports import export_csv, write_all, write_csv, write_json
from lexgauge.sources.completions import Server
from lexgauge.sources.result_tree import load_tree, read_csv
from lexgauge.sources.settings import json_option, read_settings, system_prompt, thresholds

#: Columns a result file needs for the rules.
RULE_INPUT = ["model_name", "run_id", "id", "source_en", "reference_ja", "translation_ja", "protected_tokens", "required_terms", "request_success"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexgauge")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("rules")
    r.add_argument("--input", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--config")
    r.add_argument("--encoding", default="UTF-8")
    r.add_argument("--strict-terms", action="store_true")
    r.add_argument("--allow-quotes", action="store_true")
    a = sub.add_parser("aggregate")
    a.add_argument("--results-dir", required=True)
    a.add_argument("--output-dir", required=True)
    a.add_argument("--config")
    a.add_argument("--models", nargs="*")
    a.add_argument("--accuracy-run", default="1")
    a.add_argument("--include-all-runs", action="store_true")
    a.add_argument("--exclude-smoke", action="store_true")
    c = sub.add_parser("run")
    for name in ("--input", "--output", "--model-name"):
        c.add_argument(name, required=True)
    # Where a local server listens, and the model it is asked for.
    c.add_argument("--api-url", default="http://127.0.0.1:8080/v1/chat/completions")
    c.add_argument("--api-model", default="local-model")
    c.add_argument("--input-variant", choices=sorted(VARIANTS), default="standard")
    for name, default in (("--temperature", 0.0), ("--top-p", 1.0), ("--timeout", 60.0), ("--connect-timeout", 10.0), ("--retry-wait", 2.0)):
        c.add_argument(name, type=float, default=default)
    for name, default in (("--run-id", 1), ("--max-tokens", 256), ("--seed", 42), ("--retries", 1), ("--warmup-count", 5), ("--concurrency", 1), ("--request-delay-ms", 0), ("--progress-interval", 1), ("--shuffle-seed", 42)):
        c.add_argument(name, type=int, default=default)
    for name in ("--top-k", "--start-index", "--end-index"):
        c.add_argument(name, type=int)
    for name in ("--min-p", "--repeat-penalty", "--frequency-penalty", "--presence-penalty", "--read-timeout"):
        c.add_argument(name, type=float)
    for name in ("--model-file", "--quantization", "--ids", "--categories"):
        c.add_argument(name, default="")
    for name in ("--system-prompt-file", "--chat-template-kwargs", "--chat-template-kwargs-file", "--metadata-output"):
        c.add_argument(name)
    c.add_argument("--stop", action="append")
    for name in ("--resume", "--retry-failed", "--stream", "--save-raw-response", "--shuffle", "--skip-invalid-rows"):
        c.add_argument(name, action="store_true")
    for q in (r, a, c):
        q.add_argument("--overwrite", action="store_true")
        q.add_argument("--log-level", default="INFO")
        q.add_argument("--log-file")
    return p


def run_collect(spark: SparkSession, a) -> int:
    if a.retries < 0 or a.warmup_count < 0 or a.concurrency < 1:
        raise ValueError("retries and warmup-count must not be negative, concurrency must be positive")
    if a.chat_template_kwargs and a.chat_template_kwargs_file:
        raise ValueError("give --chat-template-kwargs or --chat-template-kwargs-file, not both")
    template = a.chat_template_kwargs
    if a.chat_template_kwargs_file:
        template = read_settings(a.chat_template_kwargs_file, "chat-template-kwargs file")
    extra = {"repeat_penalty": a.repeat_penalty, "frequency_penalty": a.frequency_penalty, "presence_penalty": a.presence_penalty, "stop": a.stop, "chat_template_kwargs": json_option(template, "chat-template-kwargs")}
    same = {n: getattr(a, n) for n in ("model_name", "api_model", "model_file", "quantization", "run_id", "input_variant", "temperature", "top_p", "top_k", "min_p", "max_tokens", "seed", "stream", "concurrency", "warmup_count", "save_raw_response")}
    run = Run(**same, prompt=system_prompt(a.system_prompt_file), extra=extra)
    server = Server(a.api_url, a.timeout if a.read_timeout is None else a.read_timeout, a.retries, a.retry_wait, a.request_delay_ms / 1000, a.connect_timeout)
    listed = lambda t: [x.strip() for x in t.split(",") if x.strip()]
    choice = Choice(listed(a.ids), listed(a.categories), a.start_index, a.end_index, a.shuffle_seed if a.shuffle else None, a.skip_invalid_rows, a.retry_failed)
    return collect(spark, a.input, a.output, run, server, choice, a.overwrite, a.resume, a.metadata_output, progress=a.progress_interval)


def run_rules(spark: SparkSession, a) -> int:
    overlay = {"strict_terms": a.strict_terms, "allow_quotes": a.allow_quotes}
    config = RuleConfig.from_json(Path(a.config).read_text("utf-8-sig") if a.config else "{}", **overlay)
    raw = read_csv(spark, a.input, encoding=a.encoding)
    require_columns(raw, RULE_INPUT)
    out = apply_rules(raw, config).orderBy("record_no")
    columns = [c for c in raw.columns if c not in ("file", "record_no")]
    put = export_csv if "://" in a.output else write_csv  # a place that tasks reach, or a file beside the driver
    put(as_cells(out), a.output, [*columns, *[c for c in RULE_COLUMNS if c not in columns]], a.overwrite)
    return 0


def run_aggregate(spark: SparkSession, a) -> int:
    bounds, low = thresholds(Path(a.config).read_text("utf-8-sig") if a.config else None)
    tree = load_tree(spark, a.results_dir, a.models, a.exclude_smoke)
    if tree.facts is None:
        write_csv(tree.findings, Path(a.output_dir) / "data_quality_report.csv", overwrite=a.overwrite)
        return 4
    tables = report_tables(tree.facts, tree.findings, bounds, low, None if a.include_all_runs else a.accuracy_run)
    write_all(tables, a.output_dir, a.overwrite)
    write_json(summary_document(tables, tree.bundles, {"accuracy_run": a.accuracy_run, "include_all_runs": a.include_all_runs}), Path(a.output_dir) / "summary.json", a.overwrite)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 done, 1 settings, 2 input, 3 validation, 4 no data or no server, 5 output exists, 6 no call succeeded.

    Anything else is 6, for ``run`` 7; an interrupt is 130.
    """
    a = parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if a.log_file:
        Path(a.log_file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(a.log_file, encoding="utf-8"))
    logging.basicConfig(level=getattr(logging, a.log_level.upper(), logging.INFO), handlers=handlers, force=bool(a.log_file))
    spark = spark or SparkSession.builder.appName("lexgauge").getOrCreate()
    try:
        return {"rules": run_rules, "aggregate": run_aggregate, "run": run_collect}[a.command](spark, a)
    except KeyboardInterrupt:
        code, why = 130, "interrupted"
    except ValidationError as e:
        code, why = e.exit_code, e
    except FileNotFoundError as e:
        code, why = 2, e
    except FileExistsError as e:
        code, why = 5, e
    except ConnectionError as e:
        code, why = 4, e
    except ValueError as e:
        code, why = 1, e
    except Exception as e:  # noqa: BLE001
        code, why = 7 if a.command == "run" else 6, e
    logging.error("%s", why)
    return code


if __name__ == "__main__":
    sys.exit(main())
