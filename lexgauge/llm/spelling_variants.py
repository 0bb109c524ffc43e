"""Groups of spelling variants: words one edit apart, found through positional q-gram indexes.

One index of the vocabulary would pass through one machine, and its commonest postings hold large
shares of all words.  Words are dealt to regions instead.  A word of length L has three disjoint
positional grams that cover it; one edit touches one of them.  A region is a length and two of the
three: a word belongs to three regions of its own length, and visits three of the next length, with
its grams at the places they have there before or after an insertion.  Two words one edit apart meet
in a region, with the third gram as the place of the edit.

Within a region an inverted index takes (2-gram, position) to the words that have it, in order.  A
probe heap-merges the postings of its grams at the positions that a substitution (the same) or an
insertion (the same or the next) allows, and keeps words found at least
``longer length + 1 - 2`` times, the count that one edit leaves; postings that hold the whole region
are counted without being merged.  What is left is verified.  Regions of more than ``region_words``
words are split, and every word of theirs probes all splits.
"""

from __future__ import annotations

from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, materialize, scratch

Q = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
SPLIT = 4096


def grams(word: str) -> list[str]:
    """Padded q-grams; their positions are their places in the list."""
    padded = "\x02" * (Q - 1) + word + "\x03" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def bound(a: str, b: str) -> int:
    """How many grams words one edit apart share at least."""
    return max(len(a), len(b)) + Q - 1 - Q


def edit_place(a: str, b: str) -> int | None:
    """The first place in ``b`` of the one edit that makes ``b`` of ``a``, which is as long or one shorter; None if there is no such edit."""
    n, m = len(a), len(b)
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if n == m:
        return i if i < n and a[i + 1 :] == b[i + 1 :] else None
    s = 0
    while s < n and a[n - 1 - s] == b[m - 1 - s]:
        s += 1
    return m - 1 - s if i + s >= n else None


class Region:
    """Words of one length with an inverted index of their positional grams."""

    def __init__(self, words: list[str]):
        self.words = words
        self.postings: dict[tuple[str, int], list[int]] = {}
        for i, w in enumerate(words):
            for at, g in enumerate(grams(w)):
                self.postings.setdefault((g, at), []).append(i)

    def near(self, probe: str) -> list[tuple[int, int]]:
        """(word, place of the edit) of the words that one substitution, or one insertion if they are longer, makes of the probe."""
        length = len(self.words[0])
        shifts = (0,) if len(probe) == length else (0, 1)
        need, lists = bound(probe, self.words[0]), []
        for at, g in enumerate(grams(probe)):
            for shift in shifts:
                posting = self.postings.get((g, at + shift))
                if posting is None:
                    continue
                if len(posting) == len(self.words):
                    need -= 1
                else:
                    lists.append(posting)
        if need <= 0:
            candidates = range(len(self.words))
        elif len(lists) < need:
            return []
        else:
            candidates = [i for i, same in groupby(merge(*lists)) if need <= 1 or sum(1 for _ in same) >= need]
        found = ((i, edit_place(probe, self.words[i])) for i in candidates)
        return [(i, p) for i, p in found if p is not None]


def segment(length: int, m: int) -> tuple[int, int]:
    return m * length // 3, (m + 1) * length // 3


PAIRS = "word string, other string, other_n long"


def _pairs(batches):
    """Both directions of each pair, once: rows of a region come in order, its own words (role 0) before those that probe it (1, 2).

    A longer word may be made by an insertion at any place of a run of equal letters; the pair counts in the
    region of the first.  Words of a split region that probe another split count if they are the smaller word.
    """
    out: list[tuple[str, str, int]] = []
    now, own, counts, region, missing = None, [], [], None, 0

    def pair(a, n, b, m):
        out.extend(((a, b, m), (b, a, n)))

    def flush():
        cols = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["word", "other", "other_n"])

    def settle():
        """Pairs among a region's own words, each once."""
        if len(own) > 1:
            nonlocal region
            region = Region(own)
            for i, w in enumerate(own):
                for j, _ in region.near(w):
                    if j > i:
                        pair(w, counts[i], own[j], counts[j])

    for batch in batches:
        for key, split, m, role, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if (key, split) != now:
                settle() if region is None else None
                now, own, counts, region, missing = (key, split), [], [], None, m
            if role == 0:
                own.append(word)
                counts.append(n)
            elif own:
                if region is None:
                    settle()
                    region = region or Region(own)
                for j, place in region.near(word):
                    if role == 2 and word < own[j] or role == 1 and segment(len(own[j]), missing)[0] <= place < segment(len(own[j]), missing)[1]:
                        pair(word, n, own[j], counts[j])
            if len(out) > 50_000:
                yield flush()
    settle() if region is None else None
    yield flush()


def near_pairs(words: DataFrame, region_words: int = SPLIT) -> DataFrame:
    """(word, other, other_n), both ways, for all words of a written table (word, n) one edit apart; words have three code points or more."""
    size = F.char_length("word")
    cut = lambda n, m: F.floor(n * m / 3).cast("int")
    piece = lambda a, b: F.substring("word", a + 1, b - a)
    rows = []
    for role, total, shift in ((0, size, 0), (1, size + 1, 1)):
        # a visitor lacks one letter of the region's words: pieces behind the missing one begin a place earlier
        ends = [F.lit(0), cut(total, 1), cut(total, 2), total]
        for m in range(3):
            pieces = [piece(ends[i] - (shift if i > m else 0), ends[i + 1] - (shift if i > m else 0)) for i in range(3) if i != m]
            rows.append(F.struct(F.concat(total.cast("string"), F.lit(f":{m}:"), *pieces).alias("key"), F.lit(m).alias("m"), F.lit(role).alias("role")))
    dealt = words.select("word", "n", F.explode(F.array(*rows)).alias("r")).select("r.key", "r.m", "r.role", "word", "n")
    large = materialize(words.sparkSession, dealt.where("role = 0").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > region_words), "large-regions")
    if large.isEmpty():
        dealt = dealt.withColumn("split", F.lit(0))
    else:
        large = large.select(F.col("key").alias("__key"), F.ceil(F.col("c") / region_words).cast("int").alias("splits"))
        dealt = dealt.join(large, F.col("key") == F.col("__key"), "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
        home = F.pmod(F.xxhash64("word"), "splits").cast("int")
        dealt = dealt.withColumns({"home": home, "split": F.explode(F.sequence(F.lit(0), F.col("splits") - 1))})
        dealt = dealt.withColumn("role", F.when((F.col("role") == 0) & (F.col("split") != F.col("home")), 2).otherwise(F.col("role")))
    ordered = dealt.select("key", "split", "m", "role", "word", "n").repartition("key", "split").sortWithinPartitions("key", "split", "role")
    return ordered.mapInArrow(lean(_pairs), PAIRS)


def variants(words: DataFrame, ratio: int = 2, region_words: int = SPLIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a written table (word, n) of distinct words, three code points each at least.

    ``n_near`` counts the words one insertion, deletion or replacement of a code point away.  ``form`` is the
    one of them with the largest n, of equal ones the least in code-point order, if its n is at least
    ``ratio`` times the word's (2 or more, so that forms end).  ``root`` is where forms lead, the word itself if it has none.
    An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio has to be 2 or more")
    spark = words.sparkSession
    with scratch(spark) as made:
        best = near_pairs(words, region_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
        best = best.select(F.col("word").alias("__word"), "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
        has = F.coalesce(F.col("other_n") >= ratio * F.col("n"), F.lit(False))
        out = words.join(best, F.col("word") == F.col("__word"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("other")).alias("form"), F.when(has, F.col("other_n")).alias("form_n"))
        out = materialize(spark, out, "forms")
        links = materialize(spark, out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
        while True:  # each round doubles the steps taken; n at least doubles a step, so rounds are few
            nexts = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
            ahead = links.join(nexts, F.col("root") == F.col("at"), "left")
            if ahead.where("further is not null").isEmpty():
                break
            links = materialize(spark, ahead.select("word", F.coalesce("further", "root").alias("root")), "roots")
        links = links.withColumnRenamed("word", "__word")
        out = out.join(links, F.col("word") == F.col("__word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        out = materialize(spark, out, "variants")
        made.keep(out)
    return out


def misspelt_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a run of letters (``word``), A-Z lower-cased; one in 97, chosen by CRC-32 of ``id:run``, lacks a code point. A null id is empty, a null text has no run."""
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    with scratch(spark) as made:
        counted = misspelt_words(docs).where(F.char_length("word") >= 5).groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")
        out = variants(materialize(spark, counted, "vocabulary"))
        made.keep(out)
    return out
