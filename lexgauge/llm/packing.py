"""Packing by lexical retrieval: BM25 neighbours of a seed document fill its window."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, lean, materialize, slices, text_values
from .vocabularies import WordEndBPE, encoder, id_dtype, read_vocabulary, runs


@dataclass(frozen=True)
class Settings:
    window: int = 2048
    end_id: int = 1  # follows each document's ids
    k1: float = 1.2
    b: float = 0.75
    shard_tokens: int = 2_000_000  # of an index, which one task holds in memory
    shard_docs: int = 4096
    frequent: int = 1024  # terms of an index whose weights are kept as a matrix
    block: int = 256  # seeds scored at a time


def encode_documents(docs: DataFrame, tokenizer_path: str, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens, place): each whole text's ids and the end id, as little-endian numbers.

    ``place`` is a MinHash of the set of ids: documents that share much of it get
    the same or, by its order, random neighbours, so that shards hold like texts.
    """
    data, version = read_vocabulary(tokenizer_path)
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        bpe = encoder(WordEndBPE, version, held.value)
        end = np.array([settings.end_id], bpe.dtype).tobytes()
        rank = np.random.default_rng(7).permutation(max(bpe.names) + 1).astype(np.int32)
        width = bpe.dtype.itemsize
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                raws = [r + end for r in bpe.encode_many(text_values(part.column(1)))]
                place = [int(rank[np.frombuffer(r, bpe.dtype)[:-1]].min()) if len(r) > width else -1 for r in raws]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raws, pa.binary()), pa.array([len(r) // width for r in raws], pa.int64()), pa.array(place, pa.int64())], ["id", "ids", "n_tokens", "place"])
        bpe.memo.forget()  # the worker lives on and packs next

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, ids binary, n_tokens long, place long")


def id_type(tokenizer_path: str) -> np.dtype:
    """As the encoder's, without building one on the driver."""
    spec = json.loads(read_vocabulary(tokenizer_path)[0])
    return id_dtype(max(max(spec["model"]["vocab"].values()), *[t["id"] for t in spec["added_tokens"]]))


def distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, how often) of the distinct pairs, in order."""
    key = np.sort(doc << 32 | term)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    return key >> 32, key & 0xFFFFFFFF, n


def document_frequencies(encoded: DataFrame, dtype: np.dtype) -> tuple[np.ndarray, int, float]:
    """(documents that hold each id, documents, mean length) over all rows; as long as the vocabulary."""

    def run(batches):
        df, n, tokens = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                raws = part.column(0).to_pylist()
                size = np.fromiter(map(len, raws), np.int64, len(raws)) // dtype.itemsize
                ids = np.frombuffer(b"".join(raws), dtype).astype(np.int64)
                n, tokens = n + len(raws), tokens + len(ids)
                seen = np.bincount(distinct(np.repeat(np.arange(len(raws)), size), ids)[1])
                if len(seen) > len(df):
                    df = np.concatenate([df, np.zeros(len(seen) - len(df), np.int64)])
                df[: len(seen)] += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at], pa.int64()), pa.array([n, tokens, *df[at]], pa.int64())], ["id", "n"])

    sums = encoded.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums.column(0).to_numpy(), sums.column(1).to_numpy()
    docs, tokens = (int(n[at == k].sum()) for k in (-1, -2))
    df = np.zeros(int(at.max(initial=0)) + 1, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, docs, tokens / max(1, docs)


class Shard:
    """An inverted BM25 index over what is left to pack of some documents, and the greedy filling of windows.

    A document's query is all it holds: the weights of each of its distinct terms are
    summed.  Seeds are scored in blocks: the most frequent terms by a product of
    matrices, all others through their postings.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, s: Settings):
        self.s, self.ids = s, ids
        self.start = np.array([len(x) // s.window * s.window for x in ids], np.int64)  # full windows go by themselves
        self.left = np.array([len(x) for x in ids], np.int64) - self.start
        n = len(ids)
        rest = np.concatenate([*[x[a:] for x, a in zip(ids, self.start.tolist())], np.zeros(0, np.int64)]).astype(np.int64)
        doc, term, tf = distinct(np.repeat(np.arange(n), self.left), rest)
        del rest
        norm = (s.k1 * (1 - s.b + s.b * self.left / mean)).astype(np.float32)
        weight = (idf[term] * (s.k1 + 1)).astype(np.float32) * tf / (tf + norm[doc])
        del tf
        self.doc, self.weight = doc.astype(np.int32), weight.astype(np.float32)  # by document
        self.held = np.searchsorted(doc, np.arange(n + 1))
        by_term = np.argsort(term, kind="stable")
        terms, first, df = np.unique(term[by_term], return_index=True, return_counts=True)
        self.term = np.searchsorted(terms, term).astype(np.int32)
        self.first, self.df = first, df
        self.post_doc, self.post_weight = self.doc[by_term], self.weight[by_term]
        self.is_common = np.zeros(len(terms), bool)
        common = np.argsort(-df, kind="stable")[: s.frequent]
        self.is_common[common] = True
        self.row = np.full(len(terms), -1, np.int32)
        self.row[common] = np.arange(len(common))
        at = self.is_common[self.term]
        self.matrix = np.zeros((len(common), n), np.float32)
        self.matrix[self.row[self.term[at]], self.doc[at]] = self.weight[at]
        self.scored: dict[int, np.ndarray] = {}  # of a block of seeds

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """(seeds, documents): the BM25 score of each document for all terms of each seed."""
        n = len(self.ids)
        size = self.held[seeds + 1] - self.held[seeds]
        term = runs(self.term, self.held[seeds], size)
        row = np.repeat(np.arange(len(seeds)), size)
        common = self.is_common[term]
        has = np.zeros((len(seeds), len(self.matrix)), np.float32)
        has[row[common], self.row[term[common]]] = 1
        out = has @ self.matrix
        term, row = term[~common], row[~common]
        step = max(1, (4 << 20) // max(1, int(self.df[~self.is_common].max(initial=1))))
        for a in range(0, len(term), step):  # so many postings at a time
            t = term[a : a + step]
            at = np.repeat(row[a : a + step], self.df[t]) * n + runs(self.post_doc, self.first[t], self.df[t])
            out += np.bincount(at, runs(self.post_weight, self.first[t], self.df[t]), len(seeds) * n).reshape(out.shape).astype(np.float32)
        return out

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents with something left to pack and a term of the seed, by BM25 score; ties: in order."""
        if seed not in self.scored:
            seeds = np.append(seed, seed + 1 + np.flatnonzero(self.left[seed + 1 :])[: self.s.block - 1])
            self.scored = dict(zip(seeds.tolist(), self.scores(seeds)))
        score = np.where(self.left > 0, self.scored[seed], 0)
        score[seed] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]

    def take(self, doc: int, most: int) -> tuple[int, int, int]:
        n = min(most, int(self.left[doc]))
        piece = (doc, int(self.start[doc]), n)
        self.start[doc] += n
        self.left[doc] -= n
        return piece

    def sequences(self):
        """Lists of (document, start, length); each fills the window, but for the last one."""
        w = self.s.window
        for d, x in enumerate(self.ids):
            for a in range(0, len(x) // w * w, w):
                yield [(d, a, w)]
        waiting = 0
        n = len(self.ids)
        while True:
            while waiting < n and not self.left[waiting]:
                waiting += 1
            if waiting == n:
                return
            room = w
            row = [self.take(waiting, room)]
            room -= row[0][2]
            if room:
                near = self.neighbours(waiting)
                while room:  # whole neighbours first
                    fit = np.flatnonzero((self.left[near] <= room) & (self.left[near] > 0))
                    if not len(fit):
                        break
                    row.append(self.take(int(near[fit[0]]), room))
                    room -= row[-1][2]
                    near = near[fit[0] + 1 :]
                if room and len(near := near[self.left[near] > 0]):  # then the best one is cut to fill the rest
                    row.append(self.take(int(near[0]), room))
                    room -= row[-1][2]
            d = waiting
            while room:  # no neighbour is left: the next documents in order
                while d < n and not self.left[d]:
                    d += 1
                if d == n:
                    break
                row.append(self.take(d, room))
                room -= row[-1][2]
            yield row


def powers_of_two(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut an unfilled sequence into sequences whose lengths are powers of two, the largest first."""
    total, out, pieces = sum(p[2] for p in row), [], list(row)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            d, a, n = pieces.pop(0)
            part.append((d, a, min(n, room)))
            if n > room:
                pieces.insert(0, (d, a + room, n - room))
            room -= part[-1][2]
        out.append(part)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Documents are encoded once into a table in the shared folder; document
    frequencies count all of it.  Its rows are dealt by (place, id) ranges, so copies
    of one text spread over as many tasks as their number asks for.  A task indexes
    shards of bounded size one after another; what a shard leaves unfilled goes on
    into the next, and a task's last window is cut into powers of two, so that no
    sequence needs padding.

    A null or empty text is its end id alone.  Repeated rows are packed as often as
    they come; rows of equal id are told apart by nothing but their pieces.
    """
    spark = docs.sparkSession
    dtype = id_type(tokenizer_path)
    encoded = materialize(spark, encode_documents(docs, tokenizer_path, settings, id_col, text_col), "packing-ids")
    df, n_docs, mean = document_frequencies(encoded, dtype)
    give_back()
    held = spark.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)))
    shards = max(1, int(n_docs * mean / settings.shard_tokens / 2) + 1)
    dealt = encoded.repartitionByRange(shards, "place", "id").sortWithinPartitions("place", "id", "ids")
    kind = docs.schema[id_col].dataType

    def run(batches):
        idf = held.value
        number = TaskContext.get().partitionId() << 32
        carried: list[tuple] = []  # (id, ids, start, doc_tokens) of a shard's unfilled window

        def rows(sequences, ids, own, first, total):
            nonlocal number
            out = []
            for row in sequences:
                at = 0
                for d, a, n in row:
                    raw = own[d][a : a + n].astype("<u4").tobytes()
                    out.append((ids[d], first[d] + a, n, zlib.crc32(raw), total[d], number, at, *([raw] if with_ids else [])))
                    at += n
                number += 1
            return out

        def batch_of(out):
            c = list(zip(*out))
            arrays = [pa.array(c[0], id_kind), *(pa.array(x, pa.int64()) for x in c[1:7])]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(c[7], pa.binary())] if with_ids else [])], names)

        def pack(group, last):
            nonlocal carried
            group = [*carried, *group]
            carried = []
            ids, own, first, total = (list(x) for x in zip(*group))
            kept, unfilled = [], []
            for row in Shard(own, idf, mean, settings).sequences():
                (kept if sum(p[2] for p in row) == settings.window else unfilled).append(row)
            if last:
                kept += [part for row in unfilled for part in powers_of_two(row)]
            else:
                carried = [(ids[d], own[d][a : a + n], first[d] + a, total[d]) for row in unfilled for d, a, n in row]
            return rows(kept, ids, own, first, total)

        group, held_tokens = [], 0
        for batch in batches:
            id_kind = batch.column(0).type
            for part in slices(batch, 1, 1 << 20):
                for key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    x = np.frombuffer(raw, dtype)
                    group.append((key, x, 0, len(x)))
                    held_tokens += len(x)
                    if held_tokens >= settings.shard_tokens or len(group) >= settings.shard_docs:
                        if out := pack(group, False):
                            yield batch_of(out)
                        group, held_tokens = [], 0
        if (group or carried) and (out := pack(group, True)):
            yield batch_of(out)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.select("id", "ids").mapInArrow(lean(run), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
