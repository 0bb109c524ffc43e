"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, which has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get().rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        made = Path(tempfile.mkdtemp(prefix="lexgauge-")).as_uri()  # one machine: its own folder is shared
        spark.sparkContext.setCheckpointDir(made)
        return made
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: The folders that the innermost ``scratch`` has seen made.
_MADE: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lexgauge/{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there: a lost executor costs only the tasks it ran, and the
    rows (with whatever order or partition numbers they hold) stay as written.
    """
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


class Scratch:
    def __init__(self):
        self.kept: set[str] = set()

    def keep(self, *written: DataFrame) -> None:
        """Tables of ``materialize`` that are read after the block."""
        self.kept.update(df.written_to for df in written)


@contextmanager
def scratch(spark: SparkSession):
    """Delete the tables written in a block when it ends, but for those kept; these fall to an outer block, if there is one."""
    made, own = Scratch(), []
    _MADE.append(own)
    try:
        yield made
    finally:
        _MADE.pop()
        for path in own:
            if path not in made.kept:
                drop_path(spark, path)
            elif _MADE:
                _MADE[-1].append(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_values(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, text_at: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of about ``max_bytes`` of text, one row at least."""
    sizes = pa.compute.binary_length(batch.column(text_at)).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > first and held + n > max_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for a broadcast if it has at most ``rows`` rows (of a few numbers each)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back() -> None:
    """Return this process's freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """Give a Python worker's freed memory back when a task ends; workers live on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_table(run: Callable) -> Callable:
    """The same for a function of whole tables."""

    if run.__code__.co_argcount == 2:

        def two(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return run(left, right)
            finally:
                give_back()

        return two

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return one
