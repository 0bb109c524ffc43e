"""Collecting answers: items become requests, answers become result rows, batch by batch, with resuming."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import platform
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgauge.functions.values import KEY
from lexgauge.operators.inputs import INHERITED, RESULT_COLUMNS, input_text, payload, pending, positioned, select_items, shuffled, valid_items
from lexgauge.operators.responses import judged
from lexgauge.operators.summaries import run_summary
from lexgauge.sinks.reports import append_rows, prepare_results, write_json
from lexgauge.sources.completions import Reply, Server, complete, get_json, post, preflight, warm_up
from lexgauge.sources.result_tree import file_digest, read_csv

# Fixed value: the text of a trial request when there is no item.
TRIAL_TEXT = "Press E to interact."


@dataclass(frozen=True)
class Run:
    """What one collection run sends and records."""

    model_name: str
    api_model: str = "local-model"
    model_file: str = ""
    quantization: str = ""
    run_id: int = 1
    input_variant: str = "standard"
    prompt: str = ""
    temperature: float = 0.0
    top_p: float = 1.0
    top_k: int | None = None
    min_p: float | None = None
    max_tokens: int = 256
    seed: int = 42
    stream: bool = False
    concurrency: int = 1
    warmup_count: int = 5
    save_raw_response: bool = False
    extra: dict = field(default_factory=dict)  # settings that are sent and not recorded

    @property
    def prompt_hash(self) -> str:
        return hashlib.sha256(self.prompt.encode("utf-8")).hexdigest()

    def payload(self, text_column: str = "input_text"):
        return payload(self.api_model, self.prompt, text_column, self.temperature, self.top_p, self.max_tokens, self.seed, self.stream, top_k=self.top_k, min_p=self.min_p, **self.extra)


@dataclass(frozen=True)
class Choice:
    """Which items of a table are run, and in which order."""

    ids: list[str] | None = None
    categories: list[str] | None = None
    start: int | None = None
    end: int | None = None
    shuffle_seed: int | None = None
    skip_invalid: bool = False
    retry_failed: bool = False


def requests(items: DataFrame, run: Run, choice: Choice = Choice(), done: DataFrame | None = None, order: str = "record_no") -> DataFrame:
    """Inherited columns, ``execution_index``, ``input_text`` and ``payload`` of every item still to run.

    Items are checked, chosen, put in order, and those with a stored result left out;
    ``execution_index`` counts what remains.
    """
    df = select_items(valid_items(items, run.input_variant, choice.skip_invalid, order), choice.ids, choice.categories, choice.start, choice.end, order)
    if choice.shuffle_seed is not None:
        df, order = shuffled(df, choice.shuffle_seed, order).withColumnRenamed("execution_index", "__turn"), "__turn"
    mine = {"model_name": run.model_name, "run_id": str(run.run_id), "input_variant": run.input_variant}
    df = pending(df.withColumns({c: F.lit(v) for c, v in mine.items()}), done, KEY, choice.retry_failed)
    df = positioned(df, order).withColumnRenamed("position", "execution_index")
    kept = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in INHERITED]
    df = df.select(*kept, "execution_index", input_text(run.input_variant).alias("input_text"))
    return df.withColumn("payload", run.payload())


def result_rows(asked: DataFrame, answers: DataFrame, run: Run, server: Server) -> DataFrame:
    """``RESULT_COLUMNS`` of requests and their answers (``completions.RESULT``, whose id is the execution index)."""
    said = judged(answers, run.stream).withColumnRenamed("id", "__id")
    df = asked.drop("payload").join(said, F.col("execution_index").cast("string") == F.col("__id"))
    recorded = {c: getattr(run, c) for c in ("model_name", "api_model", "model_file", "quantization", "run_id", "input_variant", "temperature", "top_p", "top_k", "min_p", "max_tokens", "seed", "stream", "concurrency")}
    df = df.withColumns({c: F.lit(v) for c, v in recorded.items()})
    df = df.withColumns({"system_prompt_hash": F.lit(run.prompt_hash), "timeout_seconds": F.lit(float(server.timeout)), "requests_per_second": F.lit(None).cast("double"), "batch_total_time_ms": F.lit(None).cast("double")})
    if not run.save_raw_response:
        df = df.withColumn("raw_response", F.lit(""))
    return df.select(*RESULT_COLUMNS, "finished_epoch")


def throughput(rows: DataFrame, began: float, before: int = 0) -> DataFrame:
    """Time since ``began`` and calls a second as of each answer, in the order of arrival; ``before`` answers came earlier.

    The rows are one batch.  Clocks of different machines may differ.
    """
    ms = F.greatest((F.col("finished_epoch") - F.lit(began)) * 1000, F.lit(0.0))
    n = F.row_number().over(Window.orderBy("finished_epoch", "execution_index")) + F.lit(before)
    return rows.withColumns({"batch_total_time_ms": ms, "requests_per_second": F.try_divide(n.cast("double"), ms / 1000)})


def trial(spark: SparkSession, server: Server, run: Run, text: str | None, send: Callable[[Server, str], Reply] = post) -> dict:
    """The server's health and models, one tiny request, and warm-up calls; ConnectionError if the request or all calls fail."""

    def outcomes(replies: list[Reply], stream: bool) -> list:
        rows = [(i, r.body, r.ok, r.error_type, r.error) for i, r in enumerate(replies)]
        return judged(spark.createDataFrame(rows, "n int, raw_response string, ok boolean, error_type string, error string"), stream).orderBy("n").collect()

    def body(t: str) -> str:
        return spark.createDataFrame([(t,)], "input_text string").select(run.payload()).first()[0]

    wait = server.connect_timeout or server.timeout
    info = {name: get_json(server.beside(path), wait) for name, path in (("health", "/health"), ("models", "/v1/models"))}
    reply = preflight(server, body(TRIAL_TEXT), send)
    seen = outcomes([reply], False)[0]
    if not seen.request_success:
        raise ConnectionError(f"API preflight failed: {seen.error_type} {seen.error}")
    info["preflight"] = {"status": reply.status, "latency_ms": reply.latency_ms, "finish_reason": seen.finish_reason}
    info["warmup_success_count"] = 0
    if run.warmup_count > 0:
        calls = outcomes(warm_up(server, body(text or TRIAL_TEXT), run.warmup_count, send), run.stream)
        info["warmup_success_count"] = sum(c.request_success for c in calls)
        if not info["warmup_success_count"]:
            raise ConnectionError("all warm-up requests failed")
    return info


def stored_keys(spark: SparkSession, output: str, run: Run) -> DataFrame | None:
    """Keys and success of the run's stored results, one row a result of an item set, held apart from the file: that one grows."""
    if not Path(output).exists() or not Path(output).stat().st_size:
        return None
    columns = [*KEY, "request_success"]
    mine = (F.col("model_name") == run.model_name) & (F.col("run_id") == str(run.run_id)) & (F.col("input_variant") == run.input_variant)
    rows = read_csv(spark, output).where(mine).select(*columns).collect()
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def collect(spark: SparkSession, source: str, output: str, run: Run, server: Server, choice: Choice = Choice(), overwrite: bool = False, resume: bool = False, metadata: str | None = None, send: Callable[[Server, str], Reply] = post, batch: int = 16, progress: int = 1) -> int:
    """Run the items of a CSV file and write their result file and run_metadata.json; 0, or 6 if no call succeeded.

    ``batch`` requests for each concurrent caller make one job, whose rows are on disk
    before the next one begins; a run that stops loses at most one batch and resumes
    from the file.  A batch passes the driver, no more does.
    """
    if not Path(source).exists():
        raise FileNotFoundError(f"input file does not exist: {source}")
    items = read_csv(spark, source)
    done = stored_keys(spark, output, run) if resume and not overwrite else None
    planned = requests(items, run, choice, done)
    prepare_results(output, overwrite, resume)
    asked = planned.persist()
    try:
        total = asked.count()
        first = asked.where("execution_index = 1").select("input_text").collect()
        started = datetime.now().astimezone().isoformat(timespec="seconds")
        info = trial(spark, server, run, first[0][0] if first else None, send)
        began, brief, wide = time.time(), [], batch * run.concurrency
        for low in range(0, total, wide):
            part = asked.where(F.col("execution_index").between(low + 1, low + wide))
            answers = complete(part.select(F.col("execution_index").alias("id"), "payload"), server, send, run.concurrency)
            rows = result_rows(part, answers, run, server)
            if run.concurrency > 1:
                rows = throughput(rows, began, low)
            got = sorted(rows.collect(), key=lambda r: (r.finished_epoch, r.execution_index))
            append_rows(got, RESULT_COLUMNS, output)
            for n, r in enumerate(got, low + 1):
                if progress > 0 and (n % progress == 0 or n == total):
                    print(f"[{n}/{total}] {r.id} {r.category} {'PASS' if r.request_success else 'FAIL'} {r.total_latency_ms:.3f} ms elapsed={time.time() - began:.1f}s")
            brief += [(r.model_name, r.input_variant, r.request_success, r.total_latency_ms, r.generation_tokens_per_second) for r in got]
    finally:
        asked.unpersist()
    good = sum(r[2] for r in brief)
    write_json(run_metadata(spark, source, run, server, info, started, len(brief), good), metadata or Path(output).parent / "run_metadata.json", True)
    told = run_summary(spark.createDataFrame(brief, "model_name string, input_variant string, request_success boolean, total_latency_ms double, generation_tokens_per_second double"), ["model_name", "input_variant"]).collect()
    for name, value in (told[0].asDict() if told else {"model_name": run.model_name, "input_variant": run.input_variant, "total_items": 0}).items():
        print(f"{name}: {'' if value is None else f'{value:.3f}' if isinstance(value, float) else value}")
    print(f"total_elapsed_seconds: {time.time() - began:.1f}\noutput_file: {output}")
    logging.info("collected %s, %s succeeded", len(brief), good)
    return 0 if good or not brief else 6


def run_metadata(spark: SparkSession, source: str, run: Run, server: Server, info: dict, started: str, total: int, good: int) -> dict:
    """What is recorded of a run beside its rows."""
    own = {c: getattr(run, c) for c in ("model_name", "model_file", "quantization", "run_id", "input_variant", "api_model", "temperature", "top_p", "top_k", "min_p", "max_tokens", "seed", "warmup_count", "stream", "concurrency")}
    return {
        **own,
        "api_url": server.url,
        "llama_cpp_version": "",
        "started_at": started,
        "completed_at": datetime.now().astimezone().isoformat(timespec="seconds"),
        "input_file": os.path.abspath(source),
        "input_file_sha256": file_digest(spark, source),
        "system_prompt_sha256": run.prompt_hash,
        "total_items": total,
        "success_count": good,
        "failure_count": total - good,
        "connect_timeout": server.connect_timeout,
        "read_timeout": server.timeout,
        "os": platform.platform(),
        "python_version": platform.python_version(),
        "cpu": platform.processor(),
        "preflight": info,
    }
