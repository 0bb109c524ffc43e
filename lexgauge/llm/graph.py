"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, new_path


def connected_components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``links`` (columns a, b), the smallest node that links reach.

    Alternating large-star and small-star steps: each step points nodes to the
    smallest node of a neighbourhood, by an aggregation that combines before it
    shuffles and a join that AQE may split, so a node with very many links does not
    gather them in one task.  Each round is written to the shared folder; the
    driver sees only counts.
    """
    up, down = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where(F.col("a") != F.col("b")).select(up.alias("a"), down.alias("b")).distinct()
    path = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("k")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).where(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        step = small.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        old, path = path, new_path(spark, "components")
        step.write.parquet(path)
        edges = spark.read.schema(step.schema).parquet(path)
        if old:
            drop_path(spark, old)
        # settled: one link a node, to a node that has none itself
        state = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
        if state["n"] == state["nodes"] and edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
