"""Sentence scores that another program wrote as JSON, put beside the lines they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.functions.values import KEY, as_float
from lexgauge.operators.inputs import ValidationError


def read_scores(spark: SparkSession, path: str, array: str = "$", field: str = "COMET") -> DataFrame:
    """(line_no, score) of the array at the JSON path ``array``, in its order.

    Elements are numbers, or objects whose ``field`` is one; null, or what is no
    number, gives a null score in its place.  No array there is an error.
    """
    whole = spark.read.text(path, wholetext=True).select(F.get_json_object("value", array).alias("a"))
    parts = whole.select(F.from_json("a", "array<string>").alias("a"))
    if not parts.where("a IS NOT NULL").limit(1).count():
        raise ValidationError(f"no score array at {array}")
    each = parts.select(F.posexplode("a").alias("at", "e"))
    return each.select((F.col("at") + 1).cast("long").alias("line_no"), as_float(F.coalesce(F.get_json_object("e", f"$['{field}']"), F.col("e"))).alias("score"))


def attach_scores(manifest: DataFrame, scores: DataFrame, name: str = "comet_score") -> DataFrame:
    """The manifest's key columns and the score of its line; ValidationError unless both have the same lines, each once."""
    counts = manifest.select("line_no", F.lit(1).alias("m"), F.lit(0).alias("s")).union(scores.select("line_no", F.lit(0), F.lit(1))).groupBy("line_no").agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    odd = counts.agg(*[F.count_if(F.expr(c)) for c in ("m = 0", "s = 0", "m > 1 OR s > 1")]).first()
    if any(odd):
        raise ValidationError(f"scores and manifest differ: {odd[0]} scores without a line, {odd[1]} lines without a score, {odd[2]} repeated")
    return manifest.join(scores.select("line_no", F.col("score").alias(name)), "line_no").select("line_no", *[c for c in KEY if c in manifest.columns], name)
