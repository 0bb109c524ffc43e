"""Four cleaning and packing stages over ``documents``, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.llm import jaccard_join, line_templates, packing, toxicity
from lexgauge.llm.common import materialize, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the fit reads labelled rows that are not held out.

    Rows without a text are scored as empty ones; rows of equal texts have one fate.
    """
    with scratch(spark):
        model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*COLUMNS)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go but for their first place; documents of which nothing is left go with them.

    Rows that lose no line stay as they are, empty and null texts included.
    """
    out = line_templates.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    text_left = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~F.coalesce(emptied, F.lit(False))).select("doc_id", "text", "lang", "source", text_left.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the row of the smallest id stays.

    Rows of one id and one text are one row.  Rows that share an id and have different texts
    are different documents: each is judged by its own text, and of two in one group the one of
    the smaller text hash stays.  Rows without a word link with nothing and stay; so do
    rows without an id, which cannot be told apart from their group.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("__row"))
    groups = jaccard_join.jaccard_components(known, jaccard_join.Settings(k=5, num=80), id_col="__row")
    kept = groups.where(F.col("component_id") == F.col("__row")).select("__row").distinct()
    one = known.join(kept, "__row", "left_semi").dropDuplicates(["__row"])
    return one.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens from all rows; a null or empty text is its end token alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_template_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of what they write only the table that the last one reads is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as made:
        for name, stage in STAGES[:-1]:
            docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        made.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
