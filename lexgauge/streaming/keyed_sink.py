"""A table that a stream appends to by key: each key once, each batch once, whatever is repeated or fails."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class KeyedSink:
    """For ``writeStream.foreachBatch``: rows as Parquet below ``path``, in a folder a batch.

    A batch is written beside the table first and moved into it in one step, under its number.  A batch
    whose folder is there has been committed: if the stream repeats it, nothing is written.  One that failed
    before that step left nothing that readers see, and is written anew.

    Of rows with one key the first by ``order`` counts, and a key that an earlier batch holds is not
    written again.  Rows lie in ``buckets`` folders by a hash of the key, and a batch looks only into those of its
    own keys and there only at the key columns; ``compact`` joins committed batches so that
    their number does not grow without end.  Nulls are a key like others.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], buckets: int = 16, before_commit: Callable[[int], None] | None = None):
        self.path, self.keys, self.order, self.buckets, self.before_commit = path.rstrip("/"), keys, order, buckets, before_commit

    def _files(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return fs, path

    def committed(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches in the table."""
        fs, path = self._files(spark)
        root = path(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table with ``batch`` and ``bucket``; None before the first batch."""
        return spark.read.option("basePath", self.path).parquet(self.path) if self.committed(spark) else None

    def _move(self, spark: SparkSession, staged: str, batch: int) -> None:
        fs, path = self._files(spark)
        if not fs.rename(path(staged), path(f"{self.path}/batch={batch}")):
            raise OSError(f"batch {batch} could not be moved into {self.path}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = self.committed(spark)
        if batch in done or self._covered(spark, batch):
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        first = rows.groupBy(*self.keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*self.order)).alias("r")).select("r.*").withColumn("bucket", bucket)
        if done:
            touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
            held = self.read(spark).where(F.col("bucket").isin(touched)).select(*[F.col(k).alias(f"__{k}") for k in self.keys])
            on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
            first = first.join(held, on, "left_anti")
        staged = f"{self.path}/_staged/{batch}-{uuid.uuid4().hex}"
        first.write.partitionBy("bucket").parquet(staged)
        if self.before_commit:
            self.before_commit(batch)
        self._move(spark, staged, batch)

    def _covered(self, spark: SparkSession, batch: int) -> bool:
        """Whether compaction has taken the batch into another folder."""
        fs, path = self._files(spark)
        return fs.exists(path(f"{self.path}/_joined/{batch}"))

    def compact(self, spark: SparkSession) -> None:
        """Join all committed batches into the folder of the last one.

        Call it while no stream writes.  The joined folder is written first; then each batch is marked as taken
        over and removed, and the joined folder moves into the last one's place.  A stop in between is
        mended by calling it again.
        """
        fs, path = self._files(spark)
        plan = f"{self.path}/_compacted"
        done = self.committed(spark)
        if not fs.exists(path(f"{plan}/_SUCCESS")):
            if len(done) < 2:
                return
            if fs.exists(path(plan)):
                fs.delete(path(plan), True)
            self.read(spark).drop("batch").repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(plan)
        last = max([*done, *[int(s.getPath().getName()) for s in fs.listStatus(path(f"{self.path}/_joined"))]] if fs.exists(path(f"{self.path}/_joined")) else done)
        for b in done:
            fs.create(path(f"{self.path}/_joined/{b}"), True).close()
            fs.delete(path(f"{self.path}/batch={b}"), True)
        self._move(spark, plan, last)


def follow_keyed(stream: DataFrame, sink: KeyedSink, checkpoint: str) -> StreamingQuery:
    """Write all that is new of a stream to the sink, then stop; run again to continue."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
