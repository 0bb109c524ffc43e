"""Statistics that reports need beyond the built-in aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile(x: Column, p: float) -> Column:
    """Aggregate: exact, linear between ranks, over non-null values."""
    return F.percentile(x, F.lit(p))


def exclusive_p95(x: Column) -> Column:
    """Aggregate: the 19th of 20 exclusive quantiles of 20 values or more, the maximum of fewer.

    Position 19 * (n + 1) / 20 is kept in whole numbers, so it does not drift.
    """
    a = F.sort_array(F.collect_list(x))
    n = F.count(x)
    whole = ((n + 1) * 19 - F.pmod((n + 1) * 19, F.lit(20))) / 20
    part = F.pmod((n + 1) * 19, F.lit(20))
    at = lambda k: F.get(a, k.cast("int"))
    return F.when(n >= 20, (at(whole - 1) * (20 - part) + at(whole) * part) / 20).otherwise(F.max(x))
