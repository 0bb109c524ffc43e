"""Model responses: fields of a stored JSON body, and replay of a stored event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.values import trimmed

_USAGE = "prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint"
_TIMINGS = "prompt_n: bigint, predicted_n: bigint, prompt_ms: double, prompt_per_second: double, predicted_ms: double, predicted_per_second: double, cache_n: bigint"
BODY = f"struct<choices: array<struct<message: struct<content: string, reasoning_content: string, reasoning: string>, text: string, reasoning_content: string, finish_reason: string>>, usage: struct<{_USAGE}>, timings: struct<{_TIMINGS}>, timing: struct<{_TIMINGS}>>"
EVENT = f"struct<choices: array<struct<delta: struct<content: string, reasoning_content: string, reasoning: string>, finish_reason: string>>, usage: struct<{_USAGE}>, timings: struct<{_TIMINGS}>>"
FIELDS = ["translation_ja", "reasoning_content", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens", "prompt_ms", "prompt_tokens_per_second", "generation_ms", "generation_tokens_per_second", "cached_tokens"]


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def response_fields(raw: Column) -> Column:
    """struct of the result fields, error_type and error of a whole JSON body.

    A count falls back to the timings only where usage lacks its key.  An empty text
    beside reasoning is a success; without either it is an empty response.
    """
    b = F.from_json(raw, BODY)
    choice = F.get(b["choices"], 0)
    message = choice["message"]
    content = F.coalesce(message["content"], choice["text"])
    said, thought = trimmed(content), trimmed(_filled(message["reasoning_content"], message["reasoning"], choice["reasoning_content"]))
    t = lambda k: F.when(b["timings"].isNotNull(), b["timings"][k]).otherwise(b["timing"][k])

    def count(key: str, other: str) -> Column:
        there = F.array_contains(F.coalesce(F.json_object_keys(F.get_json_object(raw, "$.usage")), F.array().cast("array<string>")), key)
        return F.when(there, b["usage"][key]).otherwise(t(other))

    none = choice.isNull()
    kind = F.when(none, "missing_field").when(content.isNull(), "missing_field").when((said == "") & (thought == ""), "empty_response").otherwise("")
    error = F.when(none, "choices[0] is missing").when(content.isNull(), "message.content is missing").when((said == "") & (thought == ""), "message.content is empty").otherwise("")
    return F.struct(
        said.alias("translation_ja"),
        thought.alias("reasoning_content"),
        F.coalesce(choice["finish_reason"], F.lit("")).alias("finish_reason"),
        count("prompt_tokens", "prompt_n").alias("prompt_tokens"),
        count("completion_tokens", "predicted_n").alias("completion_tokens"),
        b["usage"]["total_tokens"].alias("total_tokens"),
        t("prompt_ms").alias("prompt_ms"),
        t("prompt_per_second").alias("prompt_tokens_per_second"),
        t("predicted_ms").alias("generation_ms"),
        t("predicted_per_second").alias("generation_tokens_per_second"),
        t("cache_n").alias("cached_tokens"),
        kind.alias("error_type"),
        error.alias("error"),
    )


def replay_stream(raw: Column) -> Column:
    """struct(content, reasoning, finish_reason, usage, timings, bad) of a stored event stream, up to [DONE].

    Deltas are joined in order; the last finish reason, usage and timings that are
    there hold; ``bad`` counts events that are no JSON object.
    """
    def let(value: Column, body) -> Column:
        """``body(value)``, evaluating ``value`` once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def up_to_stop(data: Column) -> Column:
        stop = F.array_position(data, "[DONE]")
        return F.filter(F.when(stop > 0, F.slice(data, F.lit(1), (stop - 1).cast("int"))).otherwise(data), lambda x: x != "")

    def fields(events: Column) -> Column:
        delta = lambda e: F.get(e["body"]["choices"], 0)["delta"]
        joined = lambda f: F.array_join(F.filter(F.transform(events, f), lambda x: x.isNotNull()), "")
        last = lambda f: F.get(F.reverse(F.filter(F.transform(events, f), lambda x: x.isNotNull())), 0)
        return F.struct(
            joined(lambda e: delta(e)["content"]).alias("content"),
            joined(lambda e: _filled(delta(e)["reasoning_content"], delta(e)["reasoning"])).alias("reasoning"),
            F.coalesce(last(lambda e: F.get(e["body"]["choices"], 0)["finish_reason"]), F.lit("")).alias("finish_reason"),
            last(lambda e: e["body"]["usage"]).alias("usage"),
            last(lambda e: e["body"]["timings"]).alias("timings"),
            F.size(F.filter(events, lambda e: e["bad"])).alias("bad"),
        )

    lines = F.filter(F.split(F.coalesce(raw, F.lit("")), "\r?\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = let(F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(6), F.length(x)))), up_to_stop)
    parsed = F.transform(data, lambda x: F.struct(F.from_json(x, EVENT).alias("body"), F.json_object_keys(x).isNull().alias("bad")))
    return let(parsed, fields)


def parse_responses(rows: DataFrame, raw: str = "raw_response") -> DataFrame:
    """All columns and the fields of each stored body."""
    df = rows.withColumn("__r", response_fields(F.col(raw)))
    return df.select(*[c for c in rows.columns if c not in (*FIELDS, "error_type", "error")], "__r.*")


def stream_body(raw: Column) -> Column:
    """A stored event stream as the JSON body that an unstreamed call would have returned."""
    r = replay_stream(raw)
    message = lambda x: F.struct(x["content"].alias("content"), x["reasoning"].alias("reasoning_content"))
    body = lambda x: F.to_json(F.struct(F.array(F.struct(message(x).alias("message"), x["finish_reason"].alias("finish_reason"))).alias("choices"), x["usage"].alias("usage"), x["timings"].alias("timings")))
    return F.element_at(F.transform(F.array(r), body), 1)


def judged(answers: DataFrame, stream: bool = False) -> DataFrame:
    """The fields of each answer (``completions.RESULT``), and ``request_success``: it arrived and holds a text or reasoning.

    A call that failed has no fields and keeps its own error; one that succeeded has neither error.
    """
    raw = F.col("raw_response")
    df = answers.withColumn("__r", response_fields(F.when(F.col("ok"), stream_body(raw) if stream else raw)))
    good = F.col("ok") & (F.col("__r.error_type") == "")
    said = lambda c: F.when(F.col("ok"), F.col(f"__r.{c}"))
    named = {c: F.coalesce(said(c), F.lit("")) if c in FIELDS[:3] else said(c) for c in FIELDS}
    wrong = {c: F.when(good, "").when(F.col("ok"), F.col(f"__r.{c}")).otherwise(F.col(c)) for c in ("error_type", "error")}
    return df.withColumns({**named, **wrong, "request_success": good}).drop("__r")
