"""Corpus chrF++: F-score over character n-grams up to 6 and word n-grams up to 2, recall weighted by beta."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS, WORDS, BETA = 6, 2, 2.0
_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def characters(t: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", "")


def word_tokens(t: Column) -> Column:
    """Words, a punctuation mark at the end (else at the beginning) of a longer word on its own."""
    words = F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        return F.when((F.length(w) > 1) & F.right(w, F.lit(1)).rlike(_PUNCTUATION), F.array(F.substring(w, F.lit(1), F.length(w) - 1), F.right(w, F.lit(1)))).when((F.length(w) > 1) & F.left(w, F.lit(1)).rlike(_PUNCTUATION), F.array(F.left(w, F.lit(1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(F.array(w))

    return F.flatten(F.transform(words, cut))


UNITS = 1 << 17  # characters counted at once


def _flat(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of all segments end to end, characters as whole numbers or words, and the segments' lengths."""
    if pa.types.is_list(units.type):
        return units.flatten(), pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(units.to_pylist())
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(h, r) -> np.ndarray:
    """Equal numbers for equal units of both sides."""
    if isinstance(h, np.ndarray):
        return np.unique(np.concatenate([h, r]), return_inverse=True)[1] if len(h) + len(r) else np.zeros(0, np.int64)
    return pa.concat_arrays([h, r]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _matches(h: pa.Array, r: pa.Array, most: int) -> np.ndarray:
    """(segment, order, [clipped matches, n-grams of h, n-grams of r]).

    The n-grams of an order are numbered from those of the order below and the unit that follows, so equal
    numbers are equal n-grams; a count by segment, number and side gives the matches.
    """
    flat, sizes = zip(_flat(h), _flat(r))
    units = _numbered(*flat)
    count = len(h)
    segment = np.concatenate([np.repeat(np.arange(count), s) for s in sizes])
    side = np.repeat([0, 1], [len(f) for f in flat])
    lengths = np.concatenate(sizes)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(units))  # units from here to the segment's end
    out = np.zeros((count, most, 3), np.int64)
    number = units
    for n in range(1, most + 1):
        at = np.flatnonzero(left >= n)
        if n > 1 and len(at):
            again = np.unique(number[at] * (units.max() + 1) + units[at + n - 1], return_inverse=True)[1]
            number = np.zeros(len(units), np.int64)
            number[at] = again
        if len(at):
            cells, cell = np.unique(segment[at] * (number.max() + 1) + number[at], return_inverse=True)
            each = np.stack([np.bincount(cell[side[at] == k], minlength=len(cells)) for k in (0, 1)])
            out[:, n - 1, 0] = np.bincount(cells // (number.max() + 1), each.min(0), count).astype(np.int64)
        for k in (0, 1):
            out[:, n - 1, 1 + k] = np.maximum(0, sizes[k] - n + 1)
    return out


def overlap(chars_h: pa.Array, words_h: pa.Array, chars_r: pa.Array, words_r: pa.Array) -> pa.Array:
    """For each order the clipped matches and both totals of a segment, as one list; segments are counted together, ``UNITS`` characters at a time.

    Texts and words stay in Arrow but for those that are counted, so what a worker holds does not grow with a batch's words.
    """
    length = lambda c: pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(length(chars_h) + length(chars_r)) // UNITS
    at = np.append(np.flatnonzero(np.diff(ends, prepend=-1)), len(ends))
    rows = [np.zeros((0, 3 * (CHARS + WORDS)), np.int64)]
    for a, b in zip(at, at[1:]):
        ch, wh, cr, wr = (c.slice(a, b - a) for c in (chars_h, words_h, chars_r, words_r))
        rows.append(np.concatenate([_matches(ch, cr, CHARS), _matches(wh, wr, WORDS)], 1).reshape(b - a, -1))
    counts = np.concatenate(rows)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel(), pa.int64()))


def corpus_chrf(df: DataFrame, groups: list[str], hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """(groups, chrf): clipped matches and totals of each order are summed over the segments first.

    n-grams meet only within a segment, so they are counted there, in one Arrow stage;
    what is shuffled is the partial sums of each group.
    """
    count = F.arrow_udf(overlap, "array<bigint>")
    sums = count(*[f(F.col(c)) for c in (hypothesis, reference) for f in (characters, word_tokens)])
    orders = CHARS + WORDS
    rows = df.select(*groups, sums.alias("__s"))
    total = rows.groupBy(*groups).agg(*[F.sum(F.get("__s", F.lit(i))).alias(f"__s{i}") for i in range(3 * orders)])
    each = F.array(*[F.struct(F.col(f"__s{3 * i}").alias("m"), F.col(f"__s{3 * i + 1}").alias("h"), F.col(f"__s{3 * i + 2}").alias("r")) for i in range(orders)])
    held = total.select(*groups, F.filter(each, lambda e: (e["h"] > 0) & (e["r"] > 0)).alias("e"))
    mean = lambda side: F.aggregate("e", F.lit(0.0), lambda acc, e: acc + e["m"] / e[side]) / F.nullif(F.size("e"), F.lit(0))
    averaged = held.select(*groups, mean("h").alias("p"), mean("r").alias("q"))
    b2 = BETA * BETA
    score = 100 * (1 + b2) * F.col("p") * F.col("q") / (b2 * F.col("p") + F.col("q"))
    return averaged.select(*groups, F.coalesce(F.when(F.col("p") + F.col("q") > 0, score), F.lit(0.0)).alias("chrf"))
