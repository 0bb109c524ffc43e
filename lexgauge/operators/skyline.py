"""Rows that no other row beats in all metrics: the trade-off set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import checkpointed

STEP = 256  # rows compared at once


def _beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows some row of ``by`` dominates: nowhere below it and somewhere above."""
    out = np.zeros(len(rows), bool)
    for a in range(0, len(by), STEP):
        b = by[a : a + STEP, None, :]
        left = np.flatnonzero(~out)
        if not len(left):
            break
        out[left] = ((b >= rows[left]).all(2) & (b > rows[left]).any(2)).any(0)
    return out


def _partial(columns: int):
    """Rows of a task that no row of the task dominates; what is held is what is returned."""

    def run(batches):
        held = np.zeros((0, columns))
        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            new = new[np.lexsort(-new.T[::-1])]
            for a in range(0, len(new), STEP):
                some = new[a : a + STEP]
                some = some[~_beaten(some, held)]
                some = some[~_beaten(some, some)]
                if len(some):
                    held = np.concatenate([held[~_beaten(held, some)], some])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], [f"m{i}" for i in range(columns)])

    return run


def _against_others(columns: int):
    """Of each block: its rows that neither they nor rows of the blocks before dominate. A block's own rows come first; the others are streamed."""

    def run(batches):
        now, own, fresh = None, [], True
        names = [f"m{i}" for i in range(columns)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names)

        held = np.zeros((0, columns))
        for batch in batches:
            block, foreign = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (foreign[1:] != foreign[:-1])]))
            for a, b in zip(cuts, np.append(cuts[1:], len(block))):
                if block[a] != now:
                    if now is not None:
                        if fresh:
                            held = _own(own, columns)
                        yield batch_of(held)
                    now, own, fresh = block[a], [], True
                if not foreign[a]:
                    own.append(rows[a:b])
                else:
                    if fresh:
                        held, fresh = _own(own, columns), False
                    held = held[~_beaten(held, rows[a:b])]
        if now is not None:
            yield batch_of(_own(own, columns) if fresh else held)

    return run


def _own(parts: list[np.ndarray], columns: int) -> np.ndarray:
    rows = np.concatenate(parts) if parts else np.zeros((0, columns))
    return rows[~_beaten(rows, rows)]


def skyline(df: DataFrame, high: list[str] = [], low: list[str] = [], block_rows: int = 20_000) -> DataFrame:
    """Rows that no other row dominates: as good in all metrics and better in one.

    ``high`` are metrics where more is better, ``low`` where less is.  A null (or NaN) is worse than
    any value and as good as another null.  Rows equal in all metrics stay or go together.

    Equal rows become one point.  Each task reduces its points to those that
    none of its own dominates; the points left are laid out in descending order in blocks of
    ``block_rows``, and since whatever dominates a point comes before it in that order, a
    block is compared with itself and the blocks before it, which are streamed past it.
    """
    if not high and not low:
        raise ValueError("a skyline needs a metric")
    metrics = [(c, 1) for c in high] + [(c, -1) for c in low]
    value = lambda c, sign: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(float("-inf"))).otherwise(F.col(c).cast("double") * sign + F.lit(0.0))
    names = [f"m{i}" for i in range(len(metrics))]
    schema = ", ".join(f"{n} double" for n in names)
    points = df.select(*[value(c, s).alias(n) for (c, s), n in zip(metrics, names)]).distinct()
    left = checkpointed(points.mapInArrow(_partial(len(names)), schema))
    blocks = max(1, -(-left.count() // block_rows))
    order = [F.col(n).desc() for n in names]
    placed = checkpointed(left.repartitionByRange(blocks, *order).withColumn("home", F.spark_partition_id()))
    sent = placed.withColumn("block", F.explode(F.sequence("home", F.lit(blocks - 1)))).select("block", (F.col("block") != F.col("home")).alias("foreign"), *names)
    best = sent.repartition(blocks, "block").sortWithinPartitions("block", "foreign").mapInArrow(_against_others(len(names)), schema)
    best = best.withColumnsRenamed({n: f"__{n}" for n in names})
    on = [value(c, s) == F.col(f"__{n}") for (c, s), n in zip(metrics, names)]
    return df.join(best, on, "left_semi")
