"""BPE encoding and decoding by forced-boundary splitting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, lean, slices, text_values
from .vocabularies import WordEndBPE, encoder, read_vocabulary


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of each whole text, null taken as empty.

    See ``WordEndBPE`` for the splitting.  Narrow: no shuffle, one row out for
    each row in; texts are cut into runs of 1 MB so that memory stays bounded
    by the longest single text.
    """
    data, version = read_vocabulary(tokenizer_path)
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        bpe = encoder(WordEndBPE, version, held.value)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                raws = bpe.encode_many(text_values(part.column(1)))
                ends = np.cumsum([0, *(len(r) // bpe.dtype.itemsize for r in raws)]).astype(np.int32)
                ids = np.frombuffer(b"".join(raws), bpe.dtype).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): what the tokenizer's own decode, keeping special tokens, gives for each row of ids."""
    data, version = read_vocabulary(tokenizer_path)
    held = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        bpe = encoder(WordEndBPE, version, held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [bpe.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(lean(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def codec_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), encoding and decoding in one pass over the texts.

    The same as hashing ``encode_texts`` and ``decode_ids``, without moving the
    ids through the JVM between the two.
    """
    data, version = read_vocabulary(tokenizer_path)
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        bpe = encoder(WordEndBPE, version, held.value)
        names = [bpe.names[i].encode("utf-8") if i in bpe.names else b"" for i in range(max(bpe.names) + 1)]
        digits = [b"%d" % i for i in range(len(names))]
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                n, ids_sha, text_sha = [], [], []
                for raw in bpe.encode_many(text_values(part.column(1))):
                    ids = np.frombuffer(raw, bpe.dtype).tolist()
                    n.append(len(ids))
                    ids_sha.append(sha(b" ".join(map(digits.__getitem__, ids))).hexdigest())
                    text_sha.append(sha(b" ".join(map(names.__getitem__, ids))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
