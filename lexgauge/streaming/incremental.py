"""Rules over results as they arrive, each file once, kept across restarts by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexgauge.functions.rules import RuleConfig, apply_rules


def follow_results(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    """A stream of Parquet result files of a folder."""
    return spark.readStream.schema(schema).parquet(source)


def evaluate_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, config: RuleConfig = RuleConfig()) -> StreamingQuery:
    """Append the evaluation of all files that are new, then stop; run again to continue."""
    return apply_rules(follow_results(spark, source, schema), config).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_rates(results: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and success rate by model and time window; events later than ``late`` are dropped."""
    df = results.withWatermark(time_col, late) if results.isStreaming else results
    ok = (F.lower("request_success") == "true").cast("double")
    return df.groupBy(F.window(time_col, window), "model_name").agg(F.count("*").alias("request_count"), F.avg(ok).alias("success_rate"))
