"""Evaluation items: validation, selection, prompts and request payloads, and what is left to run."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgauge.functions.values import text, trimmed

from .cut import written

# Columns an item table needs, and the variants of its input.
REQUIRED = ["id", "category", "subcategory", "difficulty", "source_en", "reference_ja", "protected_tokens", "required_terms", "evaluation_focus"]
INHERITED = ["id", "category", "subcategory", "difficulty", "context_ja", "source_en", "clean_source_en", "reference_ja", "required_terms", "protected_tokens", "evaluation_focus"]
DIFFICULTIES = ["easy", "medium", "hard"]
VARIANTS = ["standard", "ocr_clean", "ocr_noise", "context", "terminology"]
NEEDED_BY_VARIANT = {"ocr_clean": "clean_source_en", "context": "context_ja"}
# Fixed value: the instruction sent with each request unless a file gives another.
SYSTEM_PROMPT = """You are a professional game localization translator.
Translate the English game text into natural Japanese.

Output only the Japanese translation.
Do not add explanations, headings, quotation marks, or alternative translations.
Preserve numbers, percentages, key names, placeholders, tags, and proper nouns.
Do not invent information that is not present in the source text.
"""


# The columns of a collected result, in order.
RESULT_COLUMNS = [
    *INHERITED,
    "model_name", "api_model", "model_file", "quantization", "run_id", "input_variant", "execution_index", "started_at", "completed_at", "system_prompt_hash",
    "input_text", "translation_ja", "reasoning_content", "finish_reason", "total_latency_ms", "ttft_ms", "stream_duration_ms",
    "prompt_tokens", "completion_tokens", "total_tokens", "prompt_ms", "prompt_tokens_per_second", "generation_ms", "generation_tokens_per_second", "cached_tokens",
    "request_success", "http_status", "attempt_count", "retry_count", "error_type", "error",
    "temperature", "top_p", "top_k", "min_p", "max_tokens", "seed", "stream", "timeout_seconds", "total_elapsed_with_retries_ms",
    "concurrency", "requests_per_second", "batch_total_time_ms", "raw_response",
]


class ValidationError(ValueError):
    def __init__(self, message: str, exit_code: int = 3):
        super().__init__(message)
        self.exit_code = exit_code


def require_columns(df: DataFrame, required: list[str], variant: str | None = None) -> None:
    need = [*required, *([NEEDED_BY_VARIANT[variant]] if variant in NEEDED_BY_VARIANT else [])]
    if missing := [c for c in need if c not in df.columns]:
        raise ValidationError(f"missing columns: {', '.join(missing)}")


def violations(items: DataFrame, variant: str = "standard", order: str = "line_no") -> DataFrame:
    """Add ``errors``: all that is wrong with each row, in order; empty for a valid one.

    A repeated id counts against every row but the first in file order, which an
    aggregation finds; its table is written before rows look it up, so that AQE may split
    an id that very many rows have.
    """
    require_columns(items, REQUIRED, variant)
    key = trimmed("id")
    firsts = written(items.where(key != "").groupBy(key.alias("__id")).agg(F.min(order).alias("__first")), "firsts")
    df = items.withColumn("__key", key).join(firsts, F.col("__key") == F.col("__id"), "left")
    blank = lambda c: trimmed(c) == ""
    checks = [
        (F.col("__key") == "", "id is empty"),
        ((F.col("__key") != "") & (F.col(order) > F.col("__first")), "duplicate id"),
        (blank("source_en"), "source_en is empty"),
        (blank("reference_ja"), "reference_ja is empty"),
        (~F.col("difficulty").isin(DIFFICULTIES) | F.col("difficulty").isNull(), "invalid difficulty"),
    ]
    if variant in NEEDED_BY_VARIANT:
        checks.append((blank(NEEDED_BY_VARIANT[variant]), f"{NEEDED_BY_VARIANT[variant]} is empty"))
    if variant == "terminology":
        checks.append((blank("required_terms"), "required_terms is empty"))
    errors = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in checks]), lambda x: x.isNotNull())
    return df.withColumn("errors", errors).drop("__key", "__id", "__first")


def valid_items(items: DataFrame, variant: str = "standard", skip_invalid: bool = False, order: str = "line_no", preview: int = 20) -> DataFrame:
    """The rows to use; unless invalid ones are skipped they raise, naming the first ``preview`` and the number of others."""
    checked = violations(items, variant, order)
    if not skip_invalid:
        bad = checked.where(F.size("errors") > 0)
        shown = bad.orderBy(order).select(order, F.concat_ws(", ", "errors").alias("e")).limit(preview).collect()
        if shown:
            n = bad.count()
            lines = [f"line {r[0]}: {r[1]}" for r in shown] + ([f"... and {n - preview} more"] if n > preview else [])
            raise ValidationError("\n".join(lines))
    return checked.where(F.size("errors") == 0).drop("errors")


def select_items(items: DataFrame, ids: list[str] | None = None, categories: list[str] | None = None, start: int | None = None, end: int | None = None, order: str = "line_no") -> DataFrame:
    """By id and category lists, then by 1-based inclusive position in file order."""
    df = items
    if ids:
        df = df.where(F.col("id").isin(ids))
    if categories:
        df = df.where(F.col("category").isin(categories))
    if start is None and end is None:
        return df
    return positioned(df, order).where(F.col("position").between(max(start or 1, 1), end if end is not None else 1 << 62)).drop("position")


def positioned(df: DataFrame, order: str, buckets: int = 64) -> DataFrame:
    """Add ``position``, the 1-based rank by a unique column, by ranges of it rather than in one task.

    The ranges' bounds are quantiles of a fixed number of values drawn by hash.
    """
    drawn = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(16 * buckets).collect()
    cuts = F.array(*[F.lit(m) for m in sorted({r[0] for r in drawn})[16::16]]).cast(f"array<{df.schema[order].dataType.simpleString()}>")
    df = df.withColumn("__b", F.size(F.filter(cuts, lambda c: c < F.col(order))))
    sizes = df.groupBy("__b").agg(F.count("*").alias("n"))
    before = sizes.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("__before"))  # a row a bucket
    return df.join(F.broadcast(before), "__b").withColumn("position", F.row_number().over(Window.partitionBy("__b").orderBy(order)) + F.col("__before")).drop("__b", "__before")


def shuffled(items: DataFrame, seed: int, order: str = "line_no") -> DataFrame:
    """Add ``execution_index``: a seeded permutation of the rows.

    Item sets fit the driver by nature; their line numbers are permuted there as
    Python's seeded shuffle does, and joined back.
    """
    lines = [r[0] for r in items.select(order).orderBy(order).collect()]
    random.Random(seed).shuffle(lines)
    places = items.sparkSession.createDataFrame(list(zip(lines, range(1, len(lines) + 1))), f"{order} {items.schema[order].dataType.simpleString()}, execution_index long")
    return items.join(places, order)


def permuted(items: DataFrame, seed: int, order: str = "line_no", rounds: int = 6) -> DataFrame:
    """Add ``execution_index``, 1 to n: a seeded permutation of the rows by a unique column, without the driver.

    For item sets beyond what ``shuffled`` suits.  Ranks come from ``positioned``; a rank is taken as two digits
    of bases a and b, the least with a * b >= n, and passes a keyed Feistel network that adds to each digit in
    turn a hash of the other.  That permutes a * b numbers, fewer than a of which are n or more; those walk on
    through the network until they are below n, so 1 to n is permuted.  Where a walk does not end within
    its steps (all there can be up to about 4,000 rows; beyond, a chance below one in 32 ** 64) the job fails.
    """
    n = items.count()
    a = max(1, math.isqrt(n) + (math.isqrt(n) ** 2 < n))
    b = max(1, -(-n // a))
    steps = min(a * b - n + 1, 64)

    def once(x: Column) -> Column:
        left, right = F.floor(x / b), F.pmod(x, F.lit(b))
        for r in range(rounds):
            key = F.lit(f"{seed}:{r}")
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, key), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, key), F.lit(a)), F.lit(a))
        return left * b + right

    placed = positioned(items, order)
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), (F.col("position") - 1).cast("long"), lambda x, i: F.when((i > 1) & (x < n), x).otherwise(once(x)).cast("long"))
    out = placed.withColumn("__p", whole)
    ended = F.when(F.col("__p") < n, F.col("__p") + 1).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("long"))
    return out.withColumn("execution_index", ended).drop("position", "__p")


def input_text(variant: Column | str) -> Column:
    """What is sent to the model; an unknown variant is an error."""
    v = F.lit(variant) if isinstance(variant, str) else variant
    source = text("source_en")
    headed = lambda head, c: F.concat(F.lit(f"{head}:\n"), text(c), F.lit("\n\nText:\n"), source)
    unknown = F.raise_error(F.concat(F.lit("unsupported input variant: "), v)).cast("string")
    return F.when(v.isin("standard", "ocr_noise"), source).when(v == "ocr_clean", text("clean_source_en")).when(v == "context", headed("Context", "context_ja")).when(v == "terminology", headed("Terminology", "required_terms")).otherwise(unknown)


def payload(model: str, prompt: str, text_column: str = "input_text", temperature: float = 0.0, top_p: float = 1.0, max_tokens: int = 256, seed: int = 42, stream: bool = False, **optional) -> Column:
    """The request's JSON; optional settings appear only if they are given."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    cells = [
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(prompt)), message("user", F.col(text_column))).alias("messages"),
        F.lit(float(temperature)).alias("temperature"),
        F.lit(float(top_p)).alias("top_p"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(seed).alias("seed"),
        F.lit(stream).alias("stream"),
    ]
    more = "".join(f",{json.dumps(k)}:{json.dumps(v, ensure_ascii=False, separators=(',', ':'))}" for k, v in optional.items() if v is not None)
    base = F.to_json(F.struct(*cells))
    return F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit(more + "}")) if more else base


def pending(items: DataFrame, done: DataFrame | None, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """Items without a stored result; keys with an empty part do not count as stored, nor failed ones if those are retried."""
    if done is None:
        return items
    stored = done.where(~F.greatest(*[(text(k) == "").cast("int") for k in keys]).cast("boolean")) if len(keys) > 1 else done.where(text(keys[0]) != "")
    if retry_failed:
        stored = stored.where(F.lower(text("request_success")) == "true")
    return items.join(stored.select(*keys).distinct(), keys, "left_anti")
