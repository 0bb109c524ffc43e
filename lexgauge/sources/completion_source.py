"""A data source of completions: ``spark.read.format("completions")`` calls a server, or reads stored answers.

Register it once a session with ``register``.  Options:

* ``requests``: Parquet files with id and payload; ``url``: the server that answers them.  ``callers`` (1) is the
  number of partitions, ``pool`` (1) how many requests each has out at once; ``timeout``, ``retries``, ``wait``, ``delay`` as for
  ``Server``.
* ``stored``: Parquet files with id and raw_response instead: no server is called.

Row groups are dealt to the callers; with fewer row groups than callers, rows are. Paths may be in any
store that Arrow reads (file, HDFS, S3, GCS).  A partition that Spark repeats calls the server again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .completions import RESULT, Server, answers

ROWS = 256  # of stored answers taken at once
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}
_FIELDS = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in RESULT.split(", ")])


@dataclass
class Caller(InputPartition):
    """Which row groups a partition reads, and of their rows which share (one of ``step``, the ``first`` one on)."""

    groups: list[tuple[str, int]]
    first: int = 0
    step: int = 1


def parquet_files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The Parquet files of a path, without those a writer has not committed."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if store.get_file_info(at).type == fs.FileType.File:
        return store, [at]
    inside = lambda p: p[len(at) :].strip("/").split("/")
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return store, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not any(x[:1] in "_." for x in inside(f.path)))


class CompletionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.stored = options.get("stored")
        self.path = self.stored or options.get("requests")
        if not self.path or not self.stored and not options.get("url"):
            raise ValueError("name stored answers, or requests and the url of a server")
        self.callers, self.pool = int(options.get("callers", 1)), int(options.get("pool", 1))
        number = lambda k, default: float(options.get(k, default))
        self.server = Server(options.get("url", ""), number("timeout", 60), int(options.get("retries", 1)), number("wait", 2), number("delay", 0))

    def partitions(self) -> list[Caller]:
        store, files = parquet_files(self.path)
        groups = []
        for f in files:
            with store.open_input_file(f) as source:
                groups += [(f, i) for i in range(pq.ParquetFile(source).metadata.num_row_groups)]
        if not groups:
            return [Caller([])]
        if len(groups) < self.callers:
            return [Caller(groups, i, self.callers) for i in range(self.callers)]
        return [Caller(groups[i :: self.callers]) for i in range(self.callers)]

    def rows(self, part: Caller, second: str) -> Iterator[tuple[str, str]]:
        store, _ = parquet_files(self.path)
        n = 0
        for path, group in part.groups:
            with store.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(ROWS, row_groups=[group], columns=["id", second]):
                    for pair in zip(*(batch.column(c).cast(pa.string()).to_pylist() for c in ("id", second))):
                        if n % part.step == part.first:
                            yield pair
                        n += 1

    def read(self, partition: Caller) -> Iterator[pa.RecordBatch]:
        if self.stored:
            done = ((i, body, body is not None, 200 if body is not None else None, "" if body is not None else "missing", "", *[None] * 9) for i, body in self.rows(partition, "raw_response"))
            held: list[tuple] = []
            for row in done:
                held.append(row)
                if len(held) == ROWS:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)
            return
        for row in answers(self.server, self.rows(partition, "payload"), pool=self.pool):
            yield _batch([row])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


class CompletionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "completions"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> CompletionReader:
        return CompletionReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CompletionSource)
