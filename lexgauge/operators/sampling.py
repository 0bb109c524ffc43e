"""Choosing rows for people to review, hiding models, and resampled intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .divergence import strongly_divergent
from .facts import ensure_typed, optional


def review_sample(facts: DataFrame, seed: int = 42, per_category: int = 10, lowest: float = 0.2, per_variant: int = 40, differing: float = 0.1) -> DataFrame:
    """Rows with the reasons that chose them.

    All failed rows and lost protected tokens; ``per_variant`` noisy items of each model; the lowest share by
    score within a model; ``per_category`` drawn by MD5 of key and seed, which any tool can repeat; the share
    ``differing`` of items whose texts lie farthest apart between models.  Ranks are taken within model and category, or
    against one threshold a model, so no window holds the whole table.
    """
    df = ensure_typed(facts)
    df = df.withColumns({c: optional(df, c) for c in ("model_name", "run_id", "id", "input_variant", "category")})
    draw = F.md5(F.concat_ws("|", "id", "run_id", "input_variant", F.lit(seed)))
    low = df.groupBy(F.col("model_name").alias("__m")).agg(F.percentile("f_comet", F.lit(lowest)).alias("__low"))
    texts = strongly_divergent(df, differing).select(F.col("id").alias("__i"), F.col("input_variant").alias("__v"), F.lit(True).alias("__differs"))
    df = df.join(F.broadcast(low), F.col("model_name") == F.col("__m"), "left").join(texts, (F.col("id") == F.col("__i")) & (F.col("input_variant") == F.col("__v")), "left")
    rank = F.row_number().over(Window.partitionBy("model_name", "category").orderBy(draw, "id", "run_id", "input_variant"))
    noisy = F.row_number().over(Window.partitionBy("model_name", "input_variant").orderBy(draw, "id", "run_id"))
    why = [
        (F.col("f_critical"), "failed"),
        (~F.coalesce(F.col("f_protected"), F.lit(True)), "protected_tokens"),
        ((F.col("input_variant") == "ocr_noise") & (noisy <= per_variant), "ocr_noise"),
        (F.col("f_comet") <= F.col("__low"), "low_score"),
        (rank <= per_category, "random"),
        (F.col("__differs"), "models_differ"),
    ]
    df = df.withColumn("reasons", F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in why]), lambda x: x.isNotNull()), ";"))
    return df.where("reasons != ''").select("model_name", "run_id", "id", "input_variant", "category", "reasons")


def blind(df: DataFrame, salt: str, model: str = "model_name") -> DataFrame:
    """The model's name replaced by a salted pseudonym."""
    return df.withColumn("blind_id", F.substring(F.sha2(F.concat(F.col(model), F.lit(salt)), 256), 1, 12)).drop(model)


def weight_bounds(most: int = 12) -> list[str]:
    """Hexadecimal bounds of Poisson(1): a drawn number of 32 bits has weight k from the k-th bound on (counted from 1)."""
    bounds, term, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += term
        bounds.append(f"{min(math.ceil(total * 2**32), 2**32 - 1):08x}")
        term /= k + 1
    return bounds


def _weight(seed: int) -> Column:
    """A Poisson(1) number for an item and replicate, by inversion of the first 32 bits of an MD5, which any tool can repeat."""
    drawn = F.substring(F.md5(F.concat_ws("|", "id", F.col("replicate").cast("string"), F.lit(str(seed)))), 1, 8)
    return sum((F.when(drawn >= b, F.lit(1)).otherwise(F.lit(0)) for b in weight_bounds()), F.lit(0))


def bootstrap(rows: DataFrame, groups: list[str], value: str, n: int = 1000, seed: int = 12345) -> DataFrame:
    """(groups, mean, low, high): 95 % percentile interval of the mean over ``n`` resamples of items.

    Weights depend on item and replicate alone, so groups are resampled together and
    can be compared in pairs.  Each row makes n weights inside an aggregation that
    combines before the shuffle; what is shuffled is a sum for each group and replicate.
    """
    df = rows.where(F.col(value).isNotNull()).select(*groups, F.col("id"), F.col(value).cast("double").alias("x"))
    reps = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", _weight(seed))
    means = reps.groupBy(*groups, "replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w").cast("double")).alias("m"))
    bounds = means.groupBy(*groups).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return df.groupBy(*groups).agg(F.avg("x").alias("mean")).join(bounds, groups)


def paired_p_value(rows: DataFrame, value: str, model_a: str, model_b: str, n: int = 1000, seed: int = 12345) -> DataFrame:
    """One row: both means, their difference, and the share of resamples whose centred difference is at least as large."""
    pair = rows.where(F.col("model_name").isin(model_a, model_b) & F.col(value).isNotNull()).groupBy("id").agg(*[F.avg(F.when(F.col("model_name") == m, F.col(value).cast("double"))).alias(c) for m, c in ((model_a, "a"), (model_b, "b"))]).where("a is not null and b is not null")
    reps = pair.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", _weight(seed))
    diffs = reps.groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * (F.col("a") - F.col("b"))), F.sum("w").cast("double")).alias("d"))
    real = pair.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("difference"))
    centre = diffs.crossJoin(F.broadcast(real)).crossJoin(F.broadcast(diffs.agg(F.avg("d").alias("mid"))))  # one row each
    hit = F.abs(F.col("d") - F.col("mid")) >= F.abs(F.col("difference"))
    return centre.groupBy("mean_a", "mean_b", "difference").agg(((F.count_if(hit) + 1) / (F.count("*") + 1)).alias("p_value"))
