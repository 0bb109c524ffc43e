"""Items whose outputs differ strongly between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import checkpointed
from .facts import optional
from .ranks import top_share


def _unit_text(t: Column, unit: str) -> Column:
    """The text with a character a unit; units are characters or (UTF-8) bytes."""
    if unit == "bytes":
        return F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    if unit != "characters":
        raise ValueError(unit)
    return t


NEAR = 32  # edits of near texts


def _edits(a: Column, b: Column) -> Column:
    """Edits between two texts. Bands about the diagonal, of ``NEAR`` edits, then of an eighth of the length, are tried before all cells; a band that is too narrow says so."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    within = lambda most: F.get(F.filter(F.array(F.call_function("levenshtein", a, b, most)), lambda n: n >= 0), 0)
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(within(F.lit(NEAR)), within((longest / 8).cast("int")), F.levenshtein(a, b)))


def distance(a: Column, b: Column, unit: str = "characters") -> Column:
    """Edits between two texts as a share of the longer one, 0 to 1; two empty texts are equal. ``unit`` is characters or (UTF-8) bytes."""
    a, b = _unit_text(a, unit), _unit_text(b, unit)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.coalesce(F.try_divide(_edits(a, b).cast("double"), longest.cast("double")), F.lit(0.0))


def item_divergence(facts: DataFrame, run: str | None = "1", unit: str = "characters") -> DataFrame:
    """(id, input_variant, model_count, divergence, widest): mean and greatest distance over all pairs of models that answered an item.

    One text a model counts, the least of a key's repeated rows; ``run`` None takes the least of all
    runs.  Repeated rows are combined before items are gathered, so what meets for
    an item is a text a model.  Items of one model have no row.
    """
    df = facts.withColumns({c: optional(facts, c) for c in ("model_name", "run_id", "id", "input_variant", "translation_ja")})
    if run is not None:
        df = df.where(F.col("run_id") == run)
    texts = df.groupBy("id", "input_variant", "model_name").agg(F.min("translation_ja").alias("t"))
    # few bytes and much work a row: a stated number of partitions is not merged into fewer
    texts = texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "input_variant")
    # models of one text meet others once: a distinct text stands with its number of models
    held = texts.groupBy("id", "input_variant").agg(F.count("*").alias("models"), F.sort_array(F.collect_list(_unit_text(F.col("t"), unit))).alias("all")).where("models > 1")
    # a null text is at distance 0 from all
    items = held.select("id", "input_variant", "models", "all", F.array_distinct("all").alias("u"))
    items = items.select("id", "input_variant", "models", F.transform("u", lambda t: F.struct(t.alias("t"), F.size(F.filter("all", lambda x: x == t)).alias("n"))).alias("u"))
    rest = lambda i: F.slice("u", i + 2, F.size("u"))
    pairs = F.flatten(F.transform("u", lambda x, i: F.transform(rest(i), lambda y: F.struct(distance(x["t"], y["t"]).alias("d"), (x["n"] * y["n"]).alias("n")))))
    items = items.select("id", "input_variant", F.col("models").alias("model_count"), pairs.alias("d"))
    among = F.col("model_count") * (F.col("model_count") - 1) / 2
    mean = F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x["d"] * x["n"]) / among, 9)  # items of one divergence tie, in whatever order pairs are summed
    widest = F.coalesce(F.array_max(F.transform("d", lambda x: x["d"])), F.lit(0.0))
    return items.select("id", "input_variant", "model_count", mean.alias("divergence"), widest.alias("widest"))


def strongly_divergent(facts: DataFrame, share: float = 0.1, run: str | None = "1", unit: str = "characters") -> DataFrame:
    """The items of greatest divergence, at most ``share`` of all; items of one divergence are all in or all out, and items without a difference out."""
    return top_share(checkpointed(item_divergence(facts, run, unit)), "divergence", share).where("divergence > 0")
