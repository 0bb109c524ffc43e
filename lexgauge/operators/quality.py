"""Data-quality findings, all of one shape: severity, model_name, file, key, issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgauge.functions.values import KEY, as_float, key_or_default, key_text, text

from .cut import written

FINDING = ["severity", "model_name", "file", "key", "issue"]


def findings(df: DataFrame, severity: str, issue: Column | str, model: Column | str = "model_name", file: Column | str = "", key: Column | None = None) -> DataFrame:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    model = F.col(model) if isinstance(model, str) and model in df.columns else as_col(model)
    return df.select(F.lit(severity).alias("severity"), model.alias("model_name"), as_col(file).alias("file"), (F.lit("") if key is None else key).alias("key"), as_col(issue).alias("issue"))


def keyed(rows: DataFrame, fallback_model: Column | str = "") -> DataFrame:
    """Add k_model_name, k_run_id, k_id, k_input_variant: the composite key with its defaults."""
    return rows.withColumns({f"k_{k}": c for k, c in key_or_default(rows.columns, fallback_model).items()})


K = [f"k_{k}" for k in KEY]


def first_wins(rows: DataFrame, label: str, order: list[str], keys: list[str] = K, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(kept, findings): rows without an id and all but the first of each key are left out and reported.

    ``order`` must be total (file, then record number).  The first is found by an
    aggregation that combines before the shuffle.  The table of firsts is written before it
    meets the rows again: straight from its aggregation it would tie the join to that one's
    partitions, and AQE splits a key that very many rows carry only in a join of two plain shuffles.
    """
    blank = F.col(keys[-2]) == ""
    spot = F.struct(*order)
    some = rows.where(~blank)
    firsts = written(some.groupBy(*keys).agg(F.min(spot).alias("__first")), "firsts")
    marked = some.join(firsts, keys).withColumn("__is_first", spot == F.col("__first"))
    kept = marked.where("__is_first").drop("__first", "__is_first")
    name = F.col(file) if file in rows.columns else F.lit("")
    again = findings(marked.where(~F.col("__is_first")), "ERROR", f"{label}: duplicate composite key", F.col(keys[0]), name, key_text(*keys))
    line = F.concat(F.lit("line "), (F.col(order[-1]) + 1).cast("string"))  # records count from 1, below a header line
    no_id = findings(rows.where(blank), "ERROR", f"{label}: missing id", F.col(keys[0]), name, line)
    return kept, again.unionByName(no_id)


def without_partner(raw: DataFrame, rule: DataFrame, keys: list[str] = K) -> DataFrame:
    """Findings for keys that only one of the two tables has."""
    a = findings(raw.join(rule.select(*keys).distinct(), keys, "left_anti"), "ERROR", "raw row has no matching rule_evaluation row", F.col(keys[0]), "", key_text(*keys))
    b = findings(rule.join(raw.select(*keys).distinct(), keys, "left_anti"), "ERROR", "rule_evaluation row has no matching raw row", F.col(keys[0]), "", key_text(*keys))
    return a.unionByName(b)


def negative_latency(facts: DataFrame) -> DataFrame:
    bad = facts.where(as_float("total_latency_ms") < 0)
    return findings(bad, "WARNING", "negative latency", "model_name", "", key_text(*KEY))


RANGES = {"comet": (-1.0, 1.5, "COMET score outside expected range"), "chrf": (0.0, 100.0, "chrF score outside expected range")}


def score_range(rows: DataFrame, metric: str, column: str, file: Column | str = "") -> DataFrame:
    low, high, issue = RANGES[metric]
    x = as_float(column)
    return findings(rows.where(~x.between(low, high)), "WARNING", issue, "model_name", file, key_text(*KEY))


def item_set_diff(facts: DataFrame, bundle: str = "bundle", baseline: str | None = None) -> DataFrame:
    """Warnings on bundles whose (id, variant) set differs from the baseline's (the alphabetically first)."""
    items = facts.select(F.col(bundle).alias("b"), text("id").alias("id"), text("input_variant").alias("input_variant")).distinct()
    base = F.lit(baseline) if baseline is not None else None
    if base is None:
        first = items.agg(F.min("b").alias("base"))
        items = items.crossJoin(F.broadcast(first))  # one row
    else:
        items = items.withColumn("base", base)
    bundles = items.select("b", "base").distinct().where("b != base")
    of_base = items.where("b = base").select("id", "input_variant", F.lit(1).alias("in_base"))
    per_bundle = items.where("b != base").join(of_base, ["id", "input_variant"], "left").groupBy("b").agg(F.count("*").alias("n"), F.count("in_base").alias("both"))
    total = of_base.agg(F.count("*").alias("total"))
    out = bundles.join(per_bundle, "b").crossJoin(F.broadcast(total))  # one row
    missing, extra = F.col("total") - F.col("both"), F.col("n") - F.col("both")
    say = lambda what, n: F.concat(F.lit(f"{what} "), n.cast("string"), F.lit(" items compared with "), F.col("base"))
    return findings(out.where(missing > 0), "WARNING", say("missing", missing), F.col("b")).unionByName(findings(out.where(extra > 0), "WARNING", say("extra", extra), F.col("b")))


def readiness(facts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Per variant: rows, distinct ids, duplicates, failed and blank rows, and whether all is as expected."""
    from .facts import ensure_typed

    df = ensure_typed(facts)
    want = F.coalesce(*[F.when(F.col("input_variant") == v, F.lit(n)) for v, n in expected.items()], F.lit(0))
    out = df.groupBy("input_variant").agg(F.count("*").alias("row_count"), F.count_distinct("id").alias("id_count"), F.count_if(~F.col("f_success")).alias("failed_count"), F.count_if("f_empty").alias("blank_count"))
    ready = (F.col("row_count") == want) & (F.col("row_count") == F.col("id_count")) & (F.col("failed_count") == 0) & (F.col("blank_count") == 0)
    return out.select("*", (F.col("row_count") - F.col("id_count")).alias("duplicate_count"), ready.alias("ready"))


def category_sizes(items: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Items by category against the expected numbers."""
    spark = items.sparkSession
    want = spark.createDataFrame(list(expected.items()), "category string, expected long")
    have = items.groupBy("category").agg(F.count("*").alias("actual"))
    return want.join(have, "category", "full").select("category", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"), (F.coalesce("expected", F.lit(0)) == F.coalesce("actual", F.lit(0))).alias("matches"))


def alignment(a: DataFrame, b: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row: ids on one side alone, ids at other positions, blank texts, between two exported corpora."""
    x = a.select(F.col(id_col).alias("id"), F.col("line_no").alias("la"), F.col(text_col).alias("ta"))
    y = b.select(F.col(id_col).alias("id"), F.col("line_no").alias("lb"), F.col(text_col).alias("tb"))
    j = x.join(y, "id", "full")
    blank = lambda c: F.col(c).isNotNull() & (F.trim(c) == "")
    return j.agg(F.count_if(F.col("lb").isNull()).alias("only_left"), F.count_if(F.col("la").isNull()).alias("only_right"), F.count_if(F.col("la") != F.col("lb")).alias("moved"), F.count_if(blank("ta") | blank("tb")).alias("blank"))


def running_throughput(results: DataFrame, keys: list[str], started: str = "started_at", completed: str = "completed_at", order: str = "id") -> DataFrame:
    """Finished requests so far and requests per second at each completion, within each run."""
    w = Window.partitionBy(*keys).orderBy(completed, order)
    begin = F.min(F.col(started).cast("timestamp")).over(Window.partitionBy(*keys))
    seconds = (F.unix_micros(F.col(completed).cast("timestamp")) - F.unix_micros(begin)) / F.lit(1e6)
    return results.withColumn("done_count", F.row_number().over(w)).withColumns({"batch_total_time_ms": seconds * 1000, "requests_per_second": F.try_divide(F.col("done_count").cast("double"), seconds)})
