"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, give_back, lean, materialize, scratch, slices, text_values
from .vocabularies import runs

BITS = 20  # n-grams are hashed into 2**BITS features
ORDERS = (4, 5, 6)  # bytes of an n-gram
LEVELS = (1, 2, 4)  # an n-gram that stands so often in a text is a feature of its own


@dataclass(frozen=True)
class Settings:
    """``max_train_rows`` bounds the labelled rows that the fit reads; the others are plain hyperparameters.

    They were chosen on a fifth of the fit's own rows.  Rows of label 1 weigh as much as
    the square root of the classes' ratio asks for.
    """

    max_train_rows: int = 20_000
    max_features: int = 4096
    smoothing: float = 0.5
    ridge: float = 20.0
    steps: int = 300


@dataclass
class Model:
    """``weights`` by feature, 0 where unused; without weights ``bias`` is the constant score."""

    bias: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def __post_init__(self):
        self.used = self.weights != 0
        grams = np.arange(len(self.weights), dtype=np.uint32)
        self.grams = np.logical_or.reduce([self.used[at_level(grams, k)] for k in range(len(LEVELS))]) if len(grams) else self.used

    def score(self, text: str) -> float:
        if not len(self.weights):
            return self.bias
        z = self.bias + float(self.weights[features(text, self.grams)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def at_level(grams: np.ndarray, k: int) -> np.ndarray:
    """The feature that says that n-grams stand at least ``LEVELS[k]`` times in a text."""
    return grams if k == 0 else ((grams + np.uint32(k * 0x3C6EF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def features(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of the lower-cased text between two spaces: its hashed n-grams (of ``wanted`` ones only if given) at each level."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    found, h = [], raw
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) + (raw[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            ids = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            found.append(ids if wanted is None else ids[wanted[ids]])
    if not found:
        return np.zeros(0, np.uint32)
    grams, often = np.unique(np.concatenate(found), return_counts=True)
    return np.unique(np.concatenate([at_level(grams[often >= most], k) for k, most in enumerate(LEVELS)]))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, smoothing: float) -> np.ndarray:
    return np.log((pos + smoothing) / (n_pos + 2 * smoothing)) - np.log((neg + smoothing) / (n_neg + 2 * smoothing))


def choose(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, most: int) -> np.ndarray:
    """The features whose shares in the two classes differ most, in standard errors; ties: the smallest."""
    share = (pos + neg) / (n_pos + n_neg)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_neg))
    z = np.where(pos + neg >= 3, np.abs(pos / n_pos - neg / n_neg) / error, 0)
    best = np.lexsort((np.arange(len(z)), -z))[:most]
    return np.sort(best[z[best] > 2])


def fit_linear(at: np.ndarray, ends: np.ndarray, y: np.ndarray, ratios: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on ratio-scaled presence features, by accelerated gradient steps; the rarer class weighs more.

    ``at`` holds the rows' features one row after another, ``ends`` where each row's end.
    """
    w, b = np.zeros(len(ratios)), 0.0
    weigh = np.where(y > 0, np.sqrt((len(y) - y.sum()) / y.sum()), 1.0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n = len(y)
    blocks = [(a, min(a + 1024, n)) for a in range(0, n, 1024)]  # of rows: bounds the products held at a time
    first = np.append(0, ends)
    for t in range(1, steps + 1):
        gw, gb = ridge * w, 0.0
        scaled = w * ratios
        for i, j in blocks:
            own, size = at[first[i] : first[j]], np.diff(first[i : j + 1])
            row = np.repeat(np.arange(j - i), size)
            z = b + np.bincount(row, weights=scaled[own], minlength=j - i)
            g = weigh[i:j] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[i:j])
            gw = gw + np.bincount(own, weights=g[row], minlength=len(w)) * ratios
            gb += g.sum()
        gw, gb = gw / n, gb / n
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - t / (steps + 1)))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def held_out(id_col: str = "doc_id"):
    """Rows that no fit sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows that are not held out, at most ``max_train_rows`` of them (smallest hashes of the id, then of id and text).

    Rows without a label are left out; of repeated labels the largest holds.  Without
    both classes the model is the constant share of label 1 (0 without any row).
    Counts and feature rows are made on the executors; the driver gets at most
    2**BITS counts and ``max_train_rows`` rows of at most ``max_features`` ids.
    """
    with scratch(docs.sparkSession):
        model = fit_sample(docs, labels, settings, label_col, id_col, text_col)
    give_back()
    return model


def training_rows(docs: DataFrame, known: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of the rows with a label, written; at most ``max_train_rows``, however many rows share an id.

    Where there are more, each id's text counts once and those of the smallest hashes of id and text are taken.
    """
    spark, most = docs.sparkSession, settings.max_train_rows
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(known), id_col)
    rows = materialize(spark, rows.select("text", F.col("y").cast("int").alias("y"), F.xxhash64(id_col, "text").alias("key")), "toxicity-sample")
    if rows.count() <= most:
        return rows.select("text", "y")
    keys = rows.select("key").distinct().orderBy("key").limit(most)
    return materialize(spark, rows.dropDuplicates(["key"]).join(keys, "key", "left_semi").select("text", "y"), "toxicity-sample")


def fit_sample(docs: DataFrame, labels: DataFrame, settings: Settings, label_col: str, id_col: str, text_col: str) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y")).where(~held_out(id_col))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(settings.max_train_rows)
    known = spark.createDataFrame(known.collect(), known.schema)  # max_train_rows rows of two numbers
    sample = training_rows(docs, known, settings, id_col, text_col)

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int32)
        n = [0, 0]
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), text_values(batch.column(0))):
                seen[int(y > 0), features(text)] += 1
                n[int(y > 0)] += 1
        if sum(n):
            at = np.flatnonzero(seen.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n[1], *seen[1, at]], pa.int64()), pa.array([n[0], *seen[0, at]], pa.int64())], ["feature", "pos", "neg"])

    counts = sample.mapInArrow(lean(count), "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    at, p, n = (counts.column(k).to_numpy() for k in range(3))
    del counts
    n_pos, n_neg = (int(x[at == -1].sum()) for x in (p, n))
    if not n_pos or not n_neg:
        return Model(n_pos / max(1, n_pos + n_neg))
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    pos[at[at >= 0]], neg[at[at >= 0]] = p[at >= 0], n[at >= 0]
    del at, p, n
    chosen = choose(pos, neg, n_pos, n_neg, settings.max_features)
    ratios = log_count_ratios(pos[chosen], neg[chosen], n_pos, n_neg, settings.smoothing)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = 1
    unfitted = spark.sparkContext.broadcast(weights)

    def present(batches):
        model = Model(0.0, unfitted.value)
        for batch in batches:
            ids = [(f := features(t, model.grams))[model.used[f]].astype(np.int32) for t in text_values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["y", "ids"])

    rows = sample.mapInArrow(lean(present), "y int, ids array<int>").toArrow()
    y = (rows.column(0).to_numpy() > 0).astype(float)
    held = rows.column(1).combine_chunks()
    ids, first = np.searchsorted(chosen, held.flatten().to_numpy()).astype(np.int32), held.offsets.to_numpy()
    first = first - first[0]
    del rows, held
    order = sorted(range(len(y)), key=lambda i: (y[i], ids[first[i] : first[i + 1]].tobytes()))  # the same sums in whatever order rows came
    size = np.diff(first)[order]
    w, b = fit_linear(runs(ids, first[order], size), np.cumsum(size), y[order], ratios, settings.ridge, settings.steps)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w * ratios
    return Model(b, weights)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """(all columns, score): the model's probability for each whole text; null counts as empty.

    Row-local: equal texts have equal scores, an empty table gives an empty result, and a
    column that already has the name ``score_col`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            for part in slices(batch, text_at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([own.score(t) for t in text_values(part.column(text_at))], pa.float64())], [*names, score_col])

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col])
    names = docs.columns
    text_at = names.index(text_col)
    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, documents(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
