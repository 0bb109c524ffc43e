"""Cutting lineage between the steps of operators that run jobs, and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one machine's own folder serves where none is named and the master is local."""
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = Path(tempfile.mkdtemp(prefix="lexgauge-")).as_uri()
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder, which stays there.

    Unlike a checkpoint, which remembers how its rows were dealt out, the table is dealt anew for a join; AQE splits
    a hot key only where both sides of the join are.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
