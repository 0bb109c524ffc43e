"""Exact order statistics of groups of any size, by histograms that narrow down on the ranks asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import checkpointed

BINS = 4096
TARGETS = 100_000  # ranges that each task holds


def _place(x: Column, low: Column, high: Column, first: bool) -> Column:
    """A bin that never falls as x grows: on a logarithmic scale first, even in the range afterwards."""
    scale = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if first else (lambda c: c / 2)  # halves, so that no range overflows
    part = F.try_divide(scale(x) - scale(low), scale(high) - scale(low))
    return F.least(F.floor(F.coalesce(part, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")


def order_statistics(df: DataFrame, groups: list[str], value: str, asked: DataFrame, keep: int = 10_000, most_rounds: int = 200) -> DataFrame:
    """(groups, rank, x): the value of each rank of ``asked`` (groups, rank from 0), over the non-null values of a group.

    Each round counts the values of every open range by bin, in an aggregation that combines before
    the shuffle and makes ``BINS`` rows a range at most, and goes on with the bin that holds the rank,
    from its least to its greatest value.  A range of one value is done; one of ``keep`` values or
    fewer is sorted.  So nothing holds a group's values, however many there are or however many
    are distinct.  NaN counts as null.  Groups and ranks that do not exist give no row.  Null group keys are groups.
    """
    x = F.col(value).cast("double")
    rows = df.select(*groups, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    same = lambda left, right: [F.col(f"{left}{g}").eqNullSafe(F.col(f"{right}{g}")) for g in groups] or [F.lit(True)]
    renamed = lambda t: t.withColumnsRenamed({g: f"__t_{g}" for g in groups})

    def matched(t: DataFrame, ranges: int) -> DataFrame:
        """Rows beside the open ranges of their group that hold them; up to ``TARGETS`` ranges go to the rows, so that no task gets all rows of a group."""
        on = same("", "__t_")
        on += [F.col("__x").between(F.col("low"), F.col("high"))]
        return rows.join(F.broadcast(renamed(t)) if ranges <= TARGETS else renamed(t), on)

    ends = rows.groupBy(*groups).agg(F.min("__x").alias("low"), F.max("__x").alias("high"), F.count("*").alias("inside"))
    need = renamed(asked.select(*groups, F.col("rank").cast("long").alias("rank")).distinct())
    state = need.join(ends, same("__t_", "")).where("rank >= 0 and rank < inside").select(*[F.col(f"__t_{g}").alias(g) for g in groups], "rank", "low", "high", "inside", F.lit(0).cast("long").alias("below"))
    state = checkpointed(state)
    targets = [*groups, "rank"]
    settled = []
    for n in range(most_rounds):
        open_ = (F.col("low") < F.col("high")) & (F.col("inside") > keep)
        settled.append(state.where(~open_))
        state = state.where(open_)
        ranges = state.limit(TARGETS + 1).count()
        if not ranges:
            break
        bins = matched(state, ranges).groupBy(*[F.col(f"__t_{g}").alias(g) for g in groups], "rank", "below", _place(F.col("__x"), F.col("low"), F.col("high"), n == 0).alias("bin")).agg(F.count("*").alias("inside"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        before = F.sum("inside").over(Window.partitionBy(*targets).orderBy("bin")) - F.col("inside")
        bins = bins.withColumn("below", F.col("below") + before)
        state = checkpointed(bins.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("inside"))).select(*targets, "low", "high", "inside", "below"))
    else:
        raise RuntimeError("the ranges did not narrow down")
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    one = done.where("low = high").select(*targets, F.col("low").alias("x"))
    few = done.where("low < high")
    few = matched(few, few.limit(TARGETS + 1).count()).groupBy(*[F.col(f"__t_{g}").alias(g) for g in groups], "rank", "below").agg(F.sort_array(F.collect_list("__x")).alias("v"))
    return one.unionByName(few.select(*targets, F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("x")))


def percentiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, float], keep: int = 10_000) -> DataFrame:
    """(groups, one column a percentage): linear between ranks, the digits of the built-in exact percentile, for groups of any size."""
    x = F.col(value).cast("double")
    sizes = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*groups).agg(F.count("*").alias("__n"))
    spots = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("__n") - 1) * F.lit(p)).alias("at")) for name, p in wanted.items()])
    spots = checkpointed(sizes.select(*groups, F.explode(spots).alias("s")).select(*groups, "s.name", "s.at"))
    ends = spots.select(*groups, "name", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"))
    found = order_statistics(df, groups, value, ends.select(*groups, "rank"), keep).withColumnsRenamed({g: f"__f_{g}" for g in groups} | {"rank": "__rank"})
    on = [F.col(g).eqNullSafe(F.col(f"__f_{g}")) for g in groups] + [F.col("rank") == F.col("__rank")]
    both = ends.join(found, on).groupBy(*groups, "name", "at").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    return both.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in wanted])


def top_share(df: DataFrame, value: str, share: float, keep: int = 10_000) -> DataFrame:
    """Rows whose value is above a threshold that at most ``share`` of the non-null values exceed; equal values are all in or all out."""
    x = F.col(value).cast("double")
    n = df.where(x.isNotNull() & ~F.isnan(x)).agg(F.count("*").alias("n"))
    # the greatest value that has to stay out: rank n - 1 - floor(share * n)
    asked = n.select((F.col("n") - 1 - F.floor(F.col("n") * F.lit(share))).alias("rank"))
    bound = order_statistics(df, [], value, asked, keep).agg(F.max("x").alias("__bound"))  # null where nothing has to
    above = x.isNotNull() & ~F.isnan(x) & F.coalesce(x > F.col("__bound"), F.lit(True))
    return df.crossJoin(F.broadcast(bound)).where(above).drop("__bound")  # one row
