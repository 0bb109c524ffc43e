"""Runs that have to be repeated, as far as their rows show it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import ensure_typed, optional

RUN = ["model_name", "run_id", "input_variant"]
# Settings that have to agree between the runs of a comparison.
SETTINGS = ["temperature", "top_p", "top_k", "min_p", "max_tokens", "seed", "stream", "timeout_seconds", "concurrency"]
PROMPT = ["system_prompt_hash"]


def invalid_runs(facts: DataFrame, z: float = 3.0, settings: list[str] = SETTINGS, prompt: list[str] = PROMPT) -> DataFrame:
    """(rule, model_name, run_id, input_variant, amount, detail): one row a run and rule.

    * missing_items: ids that some run of the variant has and this one lacks.
    * duplicate_keys: rows beyond the first of their composite key.
    * failure_outlier: failed requests, where they lie more than ``z`` standard deviations above
      what the failure rate of the same model's other runs of the variant lets expect (half a failure
      is added to these, so that runs without any can be compared).
    * settings_differ, prompt_differs: rows whose settings are not those of most rows of the variant over
      all models; of equally frequent ones the least digest counts.  ``detail`` names the columns that differ.

    What only a server's log or a GPU's counters show (restarts, other load, clocks) is not in the rows.
    Rows are combined by run and id before anything is compared, so the tables compared have a row
    a run or a setting.
    """
    df = ensure_typed(facts)
    df = df.withColumns({c: optional(df, c) for c in [*RUN, "id"]} | {c: optional(df, c) for c in [*settings, *prompt]})
    keys = df.groupBy(*RUN, "id").agg(F.count("*").alias("n"), F.count_if(~F.col("f_success")).alias("failed"))
    runs = keys.groupBy(*RUN).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("ids"), F.sum(F.col("n") - 1).alias("again"))
    expected = keys.select("input_variant", "id").distinct().groupBy("input_variant").agg(F.count("*").alias("expected"))
    out = []
    found = lambda rows, rule, amount, detail=F.lit(""): out.append(rows.select(F.lit(rule).alias("rule"), *RUN, amount.cast("long").alias("amount"), detail.alias("detail")))
    found(runs.join(expected, "input_variant").where("ids < expected"), "missing_items", F.col("expected") - F.col("ids"))
    found(runs.where("again > 0"), "duplicate_keys", F.col("again"))
    sums = runs.groupBy("model_name", "input_variant").agg(F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"))
    rest = runs.join(sums, ["model_name", "input_variant"]).where("all_n > n")
    p = (F.col("all_failed") - F.col("failed") + 0.5) / (F.col("all_n") - F.col("n") + 1)
    far = (F.col("failed") - F.col("n") * p) > z * F.sqrt(F.col("n") * p * (1 - p))
    found(rest.where(far), "failure_outlier", F.col("failed"))
    for rule, columns in (("settings_differ", settings), ("prompt_differs", prompt)):
        digest = F.md5(F.concat_ws("|", *columns))
        kinds = df.groupBy(*RUN, *columns).agg(F.count("*").alias("n")).withColumn("digest", digest)
        usual = kinds.groupBy("input_variant", "digest", *columns).agg(F.sum("n").alias("n")).groupBy("input_variant").agg(F.min_by(F.struct(*columns), F.struct(-F.col("n"), "digest")).alias("usual"))
        odd = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"usual.{c}") for c in columns])
        names = F.array_join(F.filter(F.array(*[F.when(F.max(F.col(c) != F.col(f"usual.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull()), ";")
        apart = kinds.join(usual, "input_variant").where(odd).groupBy(*RUN).agg(F.sum("n").alias("n"), names.alias("names"))
        found(apart, rule, F.col("n"), F.col("names"))
    return reduce(DataFrame.unionByName, out)
