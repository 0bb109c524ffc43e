"""Per-model and grouped report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgauge.functions.stats import exclusive_p95, percentile
from lexgauge.functions.values import key_text, rate, share, trimmed

from .facts import ensure_typed, optional

DIFFICULTIES = ["easy", "medium", "hard"]


# The bounds' names and defaults.
@dataclass(frozen=True)
class Thresholds:
    """Bounds that qualify a model; None leaves a bound out."""

    minimum_success_rate: float | None = 0.995
    minimum_protected_token_pass_rate: float | None = 0.99
    minimum_format_pass_rate: float | None = 0.99
    maximum_critical_error_rate: float | None = 0.01
    maximum_empty_output_rate: float | None = 0.005


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def model_summary(facts: DataFrame, bundle: str = "bundle", accuracy_run: str | None = "1", thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row a bundle: counts and speed over all its rows, quality over its accuracy run.

    Without a row of that run (or with ``accuracy_run`` None) quality covers all rows.
    Both readings are computed in the same aggregation and one is chosen
    afterwards, so that rows are neither shuffled nor scanned twice.
    """
    df = ensure_typed(facts)
    if bundle not in df.columns:
        df = df.withColumn(bundle, F.col("model_name"))
    order = key_text("model_name", "run_id", "id", "input_variant")
    chosen = F.lit(True) if accuracy_run is None else optional(df, "run_id") == accuracy_run
    df = df.withColumns({"__acc": chosen, "__key": order})
    ok = F.col("f_success")

    quality = {
        "comet_mean": lambda on: F.avg(_when(on, F.col("f_comet"))),
        "comet_median": lambda on: F.median(_when(on, F.col("f_comet"))),
        "comet_stddev": lambda on: F.stddev_samp(_when(on, F.col("f_comet"))),
        "sentence_chrf_mean": lambda on: F.avg(_when(on, F.col("f_chrf"))),
        "protected_token_pass_rate": lambda on: F.avg(_when(on, F.col("f_protected").cast("double"))),
        "required_term_pass_rate": lambda on: F.avg(_when(on, F.col("f_required").cast("double"))),
        "format_pass_rate": lambda on: F.avg(_when(on, F.col("f_format").cast("double"))),
        "rule_pass_rate_all": lambda on: F.avg(_when(on, (F.col("f_status") == "PASS").cast("double"))),
        "rule_pass_rate_success_only": lambda on: F.avg(_when(on & ok, (F.col("f_status") == "PASS").cast("double"))),
        "rule_warn_rate": lambda on: F.avg(_when(on, (F.col("f_status") == "WARN").cast("double"))),
        "rule_fail_rate": lambda on: F.avg(_when(on, (F.col("f_status") == "FAIL").cast("double"))),
        "human_accuracy_mean": lambda on: F.avg(_when(on, F.col("f_accuracy"))),
        "human_fluency_mean": lambda on: F.avg(_when(on, F.col("f_fluency"))),
        "human_usability_pass_rate": lambda on: F.avg(_when(on, F.col("f_usable").cast("double"))),
        "critical_error_rate": lambda on: F.avg(_when(on, F.col("f_critical").cast("double"))),
    }
    first_text = lambda c: F.coalesce(F.min_by(c, _when(c != "", F.col("__key"))), F.lit(""))
    latency = _when(ok, F.col("f_latency"))
    gen = _when(ok, F.col("f_gen_tps"))
    aggs = [
        F.min_by(optional(df, "model_name"), "__key").alias("model_name"),
        first_text(optional(df, "model_file")).alias("model_file"),
        first_text(optional(df, "quantization")).alias("quantization"),
        F.count("*").alias("request_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if("f_timeout").alias("timeout_count"),
        F.count_if("f_empty").alias("empty_output_count"),
        F.avg(latency).alias("latency_mean_ms"),
        percentile(latency, 0.5).alias("latency_p50_ms"),
        percentile(latency, 0.95).alias("latency_p95_ms"),
        F.min(latency).alias("latency_min_ms"),
        F.max(latency).alias("latency_max_ms"),
        F.stddev_samp(latency).alias("latency_stddev_ms"),
        F.avg(_when(ok, F.col("f_prompt_tps"))).alias("prompt_tps_mean"),
        F.avg(gen).alias("generation_tps_mean"),
        percentile(gen, 0.5).alias("generation_tps_p50"),
        percentile(gen, 0.95).alias("generation_tps_p95"),
        F.min_by("f_chrf_corpus", _when(F.col("f_chrf_corpus").isNotNull(), F.col("__key"))).alias("chrf_corpus"),
        F.count_if("__acc").alias("__chosen"),
    ]
    for name, make in quality.items():
        aggs.append(make(F.col("__acc")).alias(f"__{name}"))
        if accuracy_run is not None:
            aggs.append(make(F.lit(True)).alias(f"__all_{name}"))
    out = df.groupBy(bundle).agg(*aggs)
    pick = lambda n: F.col(f"__{n}") if accuracy_run is None else F.when(F.col("__chosen") > 0, F.col(f"__{n}")).otherwise(F.col(f"__all_{n}"))
    out = out.withColumns({n: pick(n) for n in quality} | {
        "input_variant": F.lit("ALL"),
        "failure_count": F.col("request_count") - F.col("success_count"),
        "success_rate": rate(F.col("success_count"), F.col("request_count")),
    })
    out = qualify(out, thresholds)
    return out.select(bundle, *MODEL_COLUMNS)


# The columns of the per-model report, in order.
MODEL_COLUMNS = [
    "model_name", "model_file", "quantization", "input_variant", "request_count", "success_count", "failure_count", "success_rate", "timeout_count", "empty_output_count", "latency_mean_ms", "latency_p50_ms", "latency_p95_ms", "latency_min_ms", "latency_max_ms", "latency_stddev_ms", "prompt_tps_mean", "generation_tps_mean", "generation_tps_p50", "generation_tps_p95", "comet_mean", "comet_median", "comet_stddev", "chrf_corpus", "sentence_chrf_mean", "protected_token_pass_rate", "required_term_pass_rate", "format_pass_rate", "rule_pass_rate_all", "rule_pass_rate_success_only", "rule_warn_rate", "rule_fail_rate", "human_accuracy_mean", "human_fluency_mean", "human_usability_pass_rate", "critical_error_rate", "qualification_status", "qualification_failure_reasons",
]
# The columns of the grouped reports, in order.
GROUP_COLUMNS = ["model_name", "category", "subcategory", "difficulty", "input_variant", "request_count", "comet_mean", "sentence_chrf_mean", "protected_token_pass_rate", "required_term_pass_rate", "rule_pass_rate", "critical_error_rate", "latency_mean_ms", "latency_p50_ms", "latency_p95_ms"]


def qualify(summary: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add status and reasons: a missing metric outranks a failed bound, which outranks a pass."""
    empty_rate = rate(F.col("empty_output_count"), F.col("request_count"))
    bounds = [
        ("success_rate", F.col("success_rate"), "<", "minimum_success_rate"),
        ("protected_token_pass_rate", F.col("protected_token_pass_rate"), "<", "minimum_protected_token_pass_rate"),
        ("format_pass_rate", F.col("format_pass_rate"), "<", "minimum_format_pass_rate"),
        ("critical_error_rate", F.col("critical_error_rate"), ">", "maximum_critical_error_rate"),
        ("_empty_output_rate", empty_rate, ">", "maximum_empty_output_rate"),
    ]
    missing, failed = [], []
    for name, value, sign, bound in bounds:
        limit = getattr(t, bound)
        if limit is None:
            continue
        missing.append(F.when(value.isNull(), F.lit(name)))
        broken = value < limit if sign == "<" else value > limit
        failed.append(F.when(broken, F.concat(F.lit(f"{name}="), F.format_string("%.6f", value), F.lit(f" {sign} {bound}={limit:.6f}"))))
    joined = lambda xs: F.array_join(F.filter(F.array(*xs).cast("array<string>"), lambda x: x.isNotNull()), ";")
    gaps, fails = joined(missing), joined(failed)
    return summary.withColumns({
        "qualification_status": F.when(gaps != "", "INSUFFICIENT_DATA").when(fails != "", "FAIL").otherwise("PASS"),
        "qualification_failure_reasons": F.when(gaps != "", gaps).otherwise(fails),
        "_empty_output_rate": empty_rate,
    })


def group_metrics() -> list[Column]:
    ok_latency = F.when(F.col("f_success"), F.col("f_latency"))
    return [
        F.count("*").alias("request_count"),
        F.avg("f_comet").alias("comet_mean"),
        F.avg("f_chrf").alias("sentence_chrf_mean"),
        F.avg(F.col("f_protected").cast("double")).alias("protected_token_pass_rate"),
        F.avg(F.col("f_required").cast("double")).alias("required_term_pass_rate"),
        share(F.col("f_status") == "PASS").alias("rule_pass_rate"),
        share(F.col("f_critical")).alias("critical_error_rate"),
        F.avg(ok_latency).alias("latency_mean_ms"),
        percentile(ok_latency, 0.5).alias("latency_p50_ms"),
        percentile(ok_latency, 0.95).alias("latency_p95_ms"),
    ]


def group_summary(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group over all runs; keys that are not grouped by are blank."""
    df = ensure_typed(facts)
    out = df.withColumns({k: optional(df, k) for k in keys}).groupBy(*keys).agg(*group_metrics())
    return out.withColumns({c: F.lit("") for c in GROUP_COLUMNS if c not in out.columns}).select(*GROUP_COLUMNS)


CATEGORY, SUBCATEGORY, DIFFICULTY = ["model_name", "category", "input_variant"], ["model_name", "category", "subcategory", "input_variant"], ["model_name", "difficulty", "input_variant"]


def grouped_rollup(facts: DataFrame) -> DataFrame:
    """The three grouped reports in one pass by grouping sets, told apart by ``grouping``."""
    df = ensure_typed(facts)
    keys = ["model_name", "category", "subcategory", "difficulty", "input_variant"]
    df = df.withColumns({k: optional(df, k) for k in keys})
    sets = [[F.col(k) for k in s] for s in (CATEGORY, SUBCATEGORY, DIFFICULTY)]
    out = df.groupingSets(sets, *keys).agg(*group_metrics(), F.grouping("subcategory").alias("__s"), F.grouping("category").alias("__c"))
    name = F.when(F.col("__c") == 1, "difficulty").when(F.col("__s") == 1, "category").otherwise("subcategory")
    return out.select(name.alias("grouping"), *[F.coalesce(c, F.lit("")).alias(c) if c in keys else F.col(c) for c in GROUP_COLUMNS])


def sort_groups(groups: DataFrame, keys: list[str]) -> DataFrame:
    """By the keys as texts; difficulties easy, medium, hard, then any other."""
    level = F.coalesce(*[F.when(F.col("difficulty") == d, F.lit(i)) for i, d in enumerate(DIFFICULTIES)], F.lit(99))
    order = []
    for k in keys:
        order += [level, F.col(k)] if k == "difficulty" else [F.col(k)]
    return groups.orderBy(*order)


def run_summary(facts: DataFrame, keys: list[str]) -> DataFrame:
    """What a collection run prints: counts, mean, median and the exclusive 95th percentile of latencies."""
    df = ensure_typed(facts)
    ok, latency = F.col("f_success"), F.when(F.col("f_success"), F.col("f_latency"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_items"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        (100 * share(ok)).alias("success_rate_percent"),
        F.avg(latency).alias("avg_latency_ms"),
        F.median(latency).alias("p50_latency_ms"),
        exclusive_p95(latency).alias("p95_latency_ms"),
        F.avg(F.when(ok, F.col("f_gen_tps"))).alias("avg_generation_tokens_per_second"),
    )


def noise_pairs(facts: DataFrame) -> DataFrame:
    """(model_name, run_id, id, clean struct, noise struct): the two noise variants of an item side by side, nulls if unpaired."""
    df = ensure_typed(facts)
    df = df.withColumns({c: optional(df, c) for c in ("model_name", "run_id", "id", "input_variant", "subcategory")}).where(F.col("input_variant").isin("ocr_clean", "ocr_noise"))
    cells = F.struct("subcategory", "f_comet", "f_chrf", "f_protected", "f_status", "f_critical")
    side = lambda v: F.max_by(F.when(F.col("input_variant") == v, cells), F.when(F.col("input_variant") == v, F.lit(1)))
    return df.groupBy("model_name", "run_id", "id").agg(side("ocr_clean").alias("clean"), side("ocr_noise").alias("noise"))


def unpaired(facts: DataFrame) -> DataFrame:
    """Warnings for items that have one of the two variants alone."""
    return noise_pairs(facts).where(F.col("clean").isNull() | F.col("noise").isNull()).select(F.lit("WARNING").alias("severity"), "model_name", F.lit("").alias("file"), key_text("model_name", "run_id", "id").alias("key"), F.lit("missing OCR clean/noise pair").alias("issue"))


def noise_summary(facts: DataFrame, by_subcategory: bool = False) -> DataFrame:
    """Means and rates of clean and noisy inputs over paired items, and their drops."""
    pairs = noise_pairs(facts).where(F.col("clean").isNotNull() & F.col("noise").isNotNull()).withColumn("subcategory", F.col("clean.subcategory"))
    keys = ["model_name", *(["subcategory"] if by_subcategory else [])]
    aggs = [F.count("*").alias("pair_count")]
    for v in ("clean", "noise"):
        aggs += [
            F.avg(f"{v}.f_comet").alias(f"{v}_comet_mean"),
            F.avg(f"{v}.f_chrf").alias(f"{v}_chrf"),
            F.avg(F.col(f"{v}.f_protected").cast("double")).alias(f"{v}_protected_token_pass_rate"),
            share(F.col(f"{v}.f_status") == "PASS").alias(f"{v}_rule_pass_rate"),
            share(F.col(f"{v}.f_critical")).alias(f"{v}_critical_error_rate"),
        ]
    out = pairs.groupBy(*keys).agg(*aggs)
    drop = lambda m: F.col(f"clean_{m}") - F.col(f"noise_{m}")
    return out.select(
        *keys, "pair_count", "clean_comet_mean", "noise_comet_mean", drop("comet_mean").alias("comet_drop"), "clean_chrf", "noise_chrf", drop("chrf").alias("chrf_drop"),
        "clean_protected_token_pass_rate", "noise_protected_token_pass_rate", drop("protected_token_pass_rate").alias("protected_token_pass_rate_drop"),
        "clean_rule_pass_rate", "noise_rule_pass_rate", drop("rule_pass_rate").alias("rule_pass_rate_drop"),
        "clean_critical_error_rate", "noise_critical_error_rate", (-drop("critical_error_rate")).alias("critical_error_rate_increase"),
    )


def stability_summary(facts: DataFrame) -> DataFrame:
    """Agreement between runs: items of two or more distinct runs first, then each model and variant."""
    df = ensure_typed(facts)
    said = F.regexp_replace(trimmed(optional(df, "translation_ja")), "\r\n?", "\n")
    df = df.withColumns({c: optional(df, c) for c in ("model_name", "run_id", "id", "input_variant")}).withColumn("__said", said)
    items = df.groupBy("model_name", "id", "input_variant").agg(
        F.size(F.collect_set("run_id")).alias("runs"),
        F.size(F.collect_set(F.unhex(F.sha2("__said", 256)))).cast("double").alias("texts"),  # digests are held, not texts
        F.stddev_samp("f_latency").alias("latency_sd"),
        F.stddev_samp("f_gen_tps").alias("tps_sd"),
    ).where("runs >= 2")
    return items.groupBy("model_name", "input_variant").agg(
        F.count("*").alias("multi_run_item_count"),
        share(F.col("texts") == 1).alias("exact_output_match_rate"),
        F.avg("texts").alias("unique_translation_count_mean"),
        F.avg("latency_sd").alias("latency_run_variation"),
        F.avg("tps_sd").alias("generation_tps_run_variation"),
    )


# The columns of the failed cases, in order.
FAILED_COLUMNS = ["model_name", "run_id", "id", "category", "subcategory", "difficulty", "input_variant", "source_en", "reference_ja", "translation_ja", "comet_score", "rule_check_status", "failure_reasons", "human_comment"]


def failed_cases(facts: DataFrame, minimum_comet: float | None = None) -> DataFrame:
    """Rows to look at: failed or critical ones, lost protected tokens, low scores, unusable to people."""
    df = ensure_typed(facts)
    low = F.lit(False) if minimum_comet is None else F.coalesce(F.col("f_comet") < minimum_comet, F.lit(False))
    bad = F.col("f_critical") | ~F.coalesce(F.col("f_protected"), F.lit(True)) | low | ~F.coalesce(F.col("f_usable"), F.lit(True))
    comment = optional(df, "human_comment") if "human_comment" in df.columns else optional(df, "comment")
    special = {"comet_score": F.col("f_comet"), "human_comment": comment}
    return df.where(bad).select(*[special.get(c, optional(df, c)).alias(c) for c in FAILED_COLUMNS])


def sort_failed(failed: DataFrame) -> DataFrame:
    return failed.orderBy("model_name", "input_variant", "id", "run_id")


# The columns of the final table, in order.
FINAL_COLUMNS = ["model_name", "model_file", "quantization", "test_item_count", "success_rate", "comet_mean", "chrf_corpus", "protected_token_pass_rate", "required_term_pass_rate", "format_pass_rate", "critical_error_rate", "human_usability_pass_rate", "latency_p50_ms", "latency_p95_ms", "generation_tps_mean", "peak_vram_mb", "ocr_comet_drop", "exact_output_match_rate", "qualification_status", "qualification_failure_reasons"]


def final_comparison(models: DataFrame, noise: DataFrame, stability: DataFrame) -> DataFrame:
    """One row a model; stability comes from the alphabetically first variant that has any."""
    drops = noise.select(F.col("model_name").alias("__n"), F.col("comet_drop").alias("ocr_comet_drop"))
    firsts = stability.groupBy(F.col("model_name").alias("__s")).agg(F.min_by("exact_output_match_rate", "input_variant").alias("exact_output_match_rate"))
    out = models.join(drops, F.col("model_name") == F.col("__n"), "left").join(firsts, F.col("model_name") == F.col("__s"), "left")
    return out.withColumns({"test_item_count": F.col("request_count"), "peak_vram_mb": F.lit("")}).select(*FINAL_COLUMNS)


def _final_order() -> list[Column]:
    """Status, critical errors, usability, score, latency, name; a usability or score of 0 ranks like none."""
    status = F.coalesce(*[F.when(F.col("qualification_status") == s, F.lit(i)) for i, s in enumerate(["PASS", "INSUFFICIENT_DATA", "FAIL"])], F.lit(3))
    some = lambda c, none: -F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(none))
    return [status, F.coalesce("critical_error_rate", F.lit(999.0)), some("human_usability_pass_rate", -1.0), some("comet_mean", -999.0), F.coalesce("latency_p95_ms", F.lit(999999999.0)), F.col("model_name")]


def sort_final(final: DataFrame) -> DataFrame:
    return final.orderBy(*_final_order())


def final_rank(final: DataFrame) -> DataFrame:
    """The final order as a column; the table has a row a model, so one window partition is small."""
    return final.withColumn("final_rank", F.row_number().over(Window.orderBy(*_final_order())))


def corpus_score_summary(facts: DataFrame) -> DataFrame:
    """Mean scores by model and variant."""
    df = ensure_typed(facts)
    return df.groupBy("model_name", "input_variant").agg(F.count("*").alias("row_count"), F.count("f_comet").alias("comet_count"), F.avg("f_comet").alias("comet_mean"), F.avg("f_chrf").alias("sentence_chrf_mean"))
