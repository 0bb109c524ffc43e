"""Token counts through a digest cache."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, new_path, path_exists, slices, text_values, whole_text
from .vocabularies import ByteLevelCounter, encoder, read_vocabulary

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The cache's counts for one tokenizer version, one row a digest (two jobs may have appended the same one)."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if path_exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """Add ``count_col``: the tokens of each row's whole text under a byte-level BPE file.

    Content is normalised only as far as counts surely stay the same: null becomes
    the empty text (0 tokens); the tokenizer has no normaliser of its own, so any
    other change could alter a count.  The content's SHA-256 and the SHA-256 of the
    tokenizer file (its version) are looked up in ``cache``, a Parquet folder in the
    executors' shared storage (a new one if not given).  Only distinct contents
    that it lacks are encoded, each once however many rows hold it, and appended.

    Copies are combined before the shuffle, so a text that fills a third of the
    rows costs one row a task, and the counts are written without repetition before
    rows look them up, so that AQE may split a digest that very many rows have.  Rows,
    their order of repetition and all other columns stay, but an existing ``count_col``
    is replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    data, version = read_vocabulary(tokenizer_path)
    cache = cache or new_path(spark, "token-cache")
    held = spark.sparkContext.broadcast(data)

    def encode(batches):
        counter = encoder(ByteLevelCounter, version, held.value)
        for batch in batches:
            for part in slices(batch, 1):
                counts = [counter.count(t) for t in text_values(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    digest = F.unhex(F.sha2(whole_text(text_col), 256))
    contents = docs.select(digest.alias("digest"), whole_text(text_col).alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    if path_exists(spark, cache):
        contents = contents.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")
    contents.mapInArrow(lean(encode), CACHE_SCHEMA).write.mode("append").parquet(cache)

    key, found = "__content_digest", "__found"
    counts = materialize(spark, read_cache(spark, cache, version), "token-counts").select(F.col("digest").alias(key), F.col("n_tokens").alias(found))
    kept = [c for c in docs.columns if c != count_col]
    return docs.withColumn(key, digest).join(counts, key, "left").select(*[F.col(f"`{c}`") for c in kept], F.col(found).alias(count_col))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
