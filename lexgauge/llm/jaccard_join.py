"""Exact Jaccard similarity join of word n-gram sets in the Jaccard metric space.

Distance is 1 - Jaccard, a metric.  Sets that share nothing with a pivot are all
at distance 1 from it, so pivots drawn from the corpus at large would tell almost
no two documents apart, and their windows would hold everything.  Pivots are
therefore drawn where distances are short:

1. Equal sets become one node.
2. Two sets within reach share one of the first few shingles in any common order
   (the prefix bound).  Each such shingle seeds a space of its own: the nodes that have
   it in their prefix.  The order puts rare shingles first, so that common passages seed
   few spaces.
3. Each space takes its most central member as pivot: the one whose shingles are
   the most common.  Members within reach of it are linked with it and so with each
   other; no pair among them is formed.
4. A region whose rows face many rows of other components takes a second pivot and is
   cut into the two pivots' Voronoi regions: each node belongs to the nearer one, and is
   copied into the other where its distances differ by twice the reach at most, so that
   any two nodes within reach meet in the region of one of them.  Regions are cut
   recursively, with distances to both pivots measured on whole sets.
5. In what remains, nodes of a region are compared with its nodes and copies only within
   the triangle-inequality windows: |d(x, pivot) - d(y, pivot)| <= reach, members of different
   components, sizes that allow it, and places of the space's shingle that leave enough
   shingles after it (a linked pair passes this in the space of its first shared shingle).

Before whole sets are moved, a pair is screened by parity sketches: each shingle
flips one bit of its set's sketch, so differing bits never outnumber the symmetric
difference.  That bound, and the difference of sizes, rule most pairs out and give
a lower bound of their distance; all others are measured on whole sets.

Every link that could join two components is tested, so components are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, documents, lean, materialize, scratch, slices, text_values
from .graph import connected_components

WORDS = 150_000  # memoised word hashes in a worker


@dataclass(frozen=True)
class Settings:
    """Link if ``den * |intersection| >= num * |union|``, over sets of distinct ``k``-word shingles.

    Shingles are ordered by counts of ``2 ** count_bits`` buckets (a broadcast of two bytes
    each); that steers cost, not results.  Regions are cut ``rounds`` times at most, as long as
    a row of theirs faces more than ``window_rows`` rows of other components on average and
    a round lessens these pairs by a fifth.
    """

    k: int = 3
    num: int = 90
    den: int = 100
    count_bits: int = 21
    rounds: int = 6
    window_rows: int = 256
    broadcast_rows: int = 500_000

    def prefix(self, n: int) -> int:
        return n - (self.num * n + self.den - 1) // self.den + 1


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of whole texts."""

    def __init__(self, k: int):
        self.k = k
        self.words: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.words
        if len(memo) > WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def of(self, text: str) -> np.ndarray:
        """A-Z lower-cased, words between ASCII white space; fewer than k words are one shingle."""
        words = text.encode("utf-8").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        h = self.hashes(words)
        k = min(self.k, n)
        s = np.full(n - k + 1, np.uint64(0x243F6A8885A308D3 + k))
        for j in range(k):
            s = (s ^ h[j : j + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(29)
        s = np.sort(s.view(np.int64))
        return s[np.concatenate([[True], s[1:] != s[:-1]])]


def rarity_order(s: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A sorted set in the order that all sets share: rare shingles first, then by hash."""
    return s[np.argsort(codes[s & (len(codes) - 1)], kind="stable")]


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Parity bits, as many as the next power of two of the set's size (64 at least), as longs.

    The exclusive or of a sketch's halves is the sketch of half the bits.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    flips = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def rarity_codes(docs: DataFrame, s: Settings, text_col: str) -> np.ndarray:
    """For each of ``2 ** count_bits`` buckets of shingles a number that grows with the sets that hold one.

    Every set counts.  A task sends its counts once, in pieces; a piece's counts are
    summed as they stream by, so memory does not grow with the tasks.
    """
    size, piece = 1 << s.count_bits, 1 << min(s.count_bits, 13)

    def pieces(counts):
        held = np.flatnonzero(counts.reshape(-1, piece).any(axis=1))
        rows = pa.array([counts[i * piece : (i + 1) * piece].tobytes() for i in held], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), rows], ["piece", "counts"])

    def count(batches):
        shingler, counts = Shingler(s.k), np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                sets = [shingler.of(t) for t in text_values(part.column(0))]
                counts += np.bincount(np.concatenate([*sets, np.zeros(0, np.int64)]) & (size - 1), minlength=size)
        yield pieces(counts)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.int64)
                sums[i] = sums[i] + x if i in sums else x
        for i, x in sums.items():
            codes = np.minimum(1024 * np.log2(1.0 + x), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([codes.tobytes()], pa.binary())], ["piece", "codes"])

    counted = docs.select(text_col).mapInArrow(lean(count), "piece int, counts binary")
    found = counted.repartition("piece").mapInArrow(lean(total), "piece int, codes binary").toArrow()
    codes = np.zeros((size // piece, piece), np.uint16)
    for i, x in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        codes[i] = np.frombuffer(x.as_buffer(), np.uint16)
    return codes.ravel()


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def shingle_sets(docs: DataFrame, s: Settings, codes: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, prefix, central, sketch) of each row; ``central`` grows with the mean frequency of the shingles."""
    held = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        shingler = Shingler(s.k)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                n, digest, prefix, central, sketch = [], [], [], [], []
                for text in text_values(part.column(1)):
                    x = shingler.of(text)
                    n.append(len(x))
                    digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                    prefix.append(rarity_order(x, held.value)[: s.prefix(len(x))] if len(x) else x)
                    central.append(float(held.value[x & (len(held.value) - 1)].mean()) if len(x) else 0.0)
                    sketch.append(sketch_of(x) if len(x) else x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(prefix), pa.array(central, pa.float64()), lists(sketch)], ["id", "n", "digest", "prefix", "central", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n long, digest binary, prefix array<long>, central double, sketch array<long>")


def whole_sets(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(digest, set array<long>) of each row."""

    def run(batches):
        shingler = Shingler(s.k)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                sets = [shingler.of(t) for t in text_values(part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), lists(sets)], ["digest", "set"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), "digest binary, set array<long>")


def screened(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """(x, y, low, open): a lower bound of each pair's distance, and whether it may be a link."""
    x, y = (reps.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}")) for c in "xy")
    half = lambda k: F.zip_with(F.slice(k, F.lit(1), (F.size(k) / 2).cast("int")), F.slice(k, (F.size(k) / 2).cast("int") + 1, (F.size(k) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    rows = pairs.join(x, "x").join(y, "y")
    rows = rows.withColumns({"kx": F.when(F.size("kx") > F.size("ky"), half(F.col("kx"))).otherwise(F.col("kx")), "ky": F.when(F.size("ky") > F.size("kx"), half(F.col("ky"))).otherwise(F.col("ky"))})
    flips = F.aggregate(F.zip_with("kx", "ky", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, v: acc + v)
    differ = F.greatest(F.when(F.size("kx") == F.size("ky"), flips).otherwise(F.lit(0)).cast("long"), F.abs(F.col("nx") - F.col("ny")))
    total = F.col("nx") + F.col("ny")
    rows = rows.select("x", "y", total.alias("total"), differ.alias("differ"))
    return rows.select("x", "y", (2 * F.col("differ") / (F.col("total") + F.col("differ"))).alias("low"), ((s.den + s.num) * F.col("differ") <= (s.den - s.num) * F.col("total")).alias("open"))


def measured(pairs: DataFrame, reps: DataFrame, rows: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(x, y, d, linked): the distance of each pair, from both whole sets, which are made anew of the texts concerned."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    wanted = bounded(materialize(spark, nodes.join(reps.select("node", "digest", "rep"), "node"), "jaccard-wanted"), s.broadcast_rows)
    texts = rows.join(wanted.select(F.col("rep").alias(id_col)), id_col, "left_semi")
    sets = whole_sets(texts, s, id_col, text_col).join(wanted.select("digest", "node"), "digest").groupBy("node").agg(F.first("set").alias("set"))
    sets = materialize(spark, sets, "jaccard-sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in "xy")
    both = F.size(F.array_intersect("sx", "sy"))
    sized = pairs.join(x, "x").join(y, "y").select("x", "y", both.alias("both"), F.size("sx").alias("nx"), F.size("sy").alias("ny"))
    union = F.col("nx") + F.col("ny") - F.col("both")
    return sized.select("x", "y", (1 - F.col("both") / union).alias("d"), (s.den * F.col("both").cast("long") >= s.num * union.cast("long")).alias("linked"))


def jaccard_components(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row, and no other column.

    ``component_id`` is the smallest id that links reach, the row's own included; ids
    are of any type that has an order.  Null and empty texts and those of white space
    have no shingle and link with nothing.  Rows without an id take the component of
    their text (null if no row with that text has one).  Links are between texts: rows
    that share an id and have different texts get each their own text's component, and
    the shared id joins nothing.  Repeated rows each have a row in the result.  Whole
    texts count, however long.  Shingles are compared by 64-bit hashes.

    Intermediate tables are deleted but for those that the result is read from.
    """
    spark = docs.sparkSession
    s = settings
    rows = docs.select(id_col, text_col)
    with scratch(spark) as made:
        first = materialize(spark, shingle_sets(rows, s, rarity_codes(rows, s, text_col), id_col, text_col), "jaccard-prefixes")
        reps = first.where(F.col("n") > 0).groupBy("digest").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "prefix", "central", "sketch")])
        # the numbers are stable, as the table is written
        reps = materialize(spark, reps.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
        members = materialize(spark, first.select("id", "n", "digest"), "jaccard-members")
        made.keep(members)
        labels = component_labels(spark, rows, reps, s, id_col, text_col)
        least = labels.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
        named = labels.join(least, "component").select("node", "least")
        of_set = reps.join(named, "node", "left").select(F.col("digest").alias("set_digest"), F.coalesce("least", "rep").alias("component"))
        of_set = materialize(spark, of_set, "jaccard-components")
        made.keep(of_set)
    out = members.join(of_set, (F.col("digest") == F.col("set_digest")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def component_labels(spark: SparkSession, rows: DataFrame, reps: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the nodes that have a link."""

    def exact(pairs: DataFrame) -> DataFrame:
        return measured(pairs, reps, rows, s, id_col, text_col)

    def tested(pairs: DataFrame, label: str) -> DataFrame:
        """(x, y, low, high, linked): bounds of each pair's distance, equal where it was measured."""
        screen = materialize(spark, screened(pairs, reps, s), f"{label}-screen")
        shut = screen.where(~F.col("open")).select("x", "y", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
        found = exact(screen.where("open").select("x", "y")).select("x", "y", F.col("d").alias("low"), F.col("d").alias("high"), "linked")
        return materialize(spark, found.unionByName(shut), label)

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        links = pairs.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
        if links.isEmpty():
            return labels
        return connected_components(spark, links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    seeds = reps.where(F.col("rep").isNotNull()).select(F.posexplode("prefix").alias("pos", "key"), "node", "n", "central")
    spaces = seeds.groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("central", "node")).alias("p")).where("c > 1").select("key", F.col("p.node").alias("pivot"))
    space = materialize(spark, seeds.drop("central").join(spaces, "key"), "jaccard-spaces")
    to_pivot = tested(space.where(F.col("node") != F.col("pivot")).select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct(), "jaccard-to-pivots")
    labels = connected_components(spark, to_pivot.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))

    # a region is (key, cell, pivot); its rows are its own nodes and copies of others, with bounds of their distance to the pivot
    region = space.join(to_pivot.select(F.col("x").alias("node"), F.col("y").alias("pivot"), "low", "high"), ["node", "pivot"], "left")
    region = region.select("key", F.lit(0).cast("long").alias("cell"), "pivot", "node", "n", "pos", F.lit(True).alias("own"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))
    reach, before = 1 - s.num / s.den + 1e-9, None
    for turn in range(1, s.rounds + 2):
        known = region.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        parts = known.groupBy("key", "cell", "comp").agg(F.count("*").alias("c"), F.max("own").alias("own"), F.min(F.when(F.col("node") != F.col("pivot"), F.struct(F.xxhash64("node", F.lit(turn)), "node"))).alias("p"))
        facing = F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))
        torn = parts.groupBy("key", "cell").agg(F.count("*").alias("parts"), F.sum("c").alias("rows"), facing.alias("cross"), F.max("own").alias("own"), F.min("p").alias("p")).where("parts > 1 and own")
        torn = torn.select("key", "cell", F.col("p.node").alias("second"), "cross", (F.col("cross") > s.window_rows * F.col("rows")).alias("wide"))
        torn = materialize(spark, torn, "jaccard-torn")
        region = materialize(spark, known.join(torn.drop("cross"), ["key", "cell"]), "jaccard-open")
        faced = torn.agg(F.count("*").alias("n"), F.sum(F.when(F.col("wide"), F.col("cross"))).alias("wide")).first()
        if not faced["n"]:
            break
        if turn > s.rounds or not faced["wide"] or (before is not None and faced["wide"] > 0.8 * before):
            labels = joined(labels, tested(windows(region, s, reach), "jaccard-windows"))
            break
        before = faced["wide"]
        wide = region.where("wide")
        pivots = wide.where("low != high").select(F.col("node").alias("x"), F.col("pivot").alias("y")).unionByName(wide.where(F.col("node") != F.col("second")).select(F.col("node").alias("x"), F.col("second").alias("y")))
        found = materialize(spark, exact(pivots.distinct()), "jaccard-cuts")
        labels = joined(labels, found)
        region = voronoi(wide, found, reach, turn).unionByName(region.where("not wide").select("key", "cell", "pivot", "node", "n", "pos", "own", "low", "high"))
        region = materialize(spark, region, "jaccard-regions")
    return labels


def voronoi(rows: DataFrame, found: DataFrame, reach: float, turn: int) -> DataFrame:
    """The rows of regions cut in two: by their pivot and a second one; a row goes to each pivot that is nearer or farther by 2 * reach at most.

    If x belongs to the first pivot p, y to the second one q and d(x, y) <= reach, then
    d(x, q) <= d(y, q) + reach <= d(y, p) + reach <= d(x, p) + 2 * reach, so x is copied to q, where y is.
    """
    at = lambda c, d: found.select(F.col("x").alias("node"), F.col("y").alias(c), F.col("d").alias(d))
    far = rows.join(at("pivot", "dp"), ["node", "pivot"], "left").join(at("second", "dq"), ["node", "second"], "left")
    far = far.withColumns({"dp": F.coalesce("dp", "low"), "dq": F.coalesce("dq", F.lit(0.0))})  # measured before, or the pivot itself
    nearer = F.col("dp") <= F.col("dq")
    child = lambda k, pivot, d, own: F.struct(F.xxhash64("cell", F.lit(2 * turn + k)).alias("cell"), F.col(pivot).alias("pivot"), (F.col("own") & own).alias("own"), F.col(d).alias("d"))
    both = F.array(F.when(F.col("dp") - F.col("dq") <= 2 * reach, child(0, "pivot", "dp", nearer)), F.when(F.col("dq") - F.col("dp") <= 2 * reach, child(1, "second", "dq", ~nearer)))
    out = far.select("key", "node", "n", "pos", F.explode(F.array_compact(both)).alias("e"))
    return out.select("key", "e.cell", "e.pivot", "node", "n", "pos", "e.own", F.col("e.d").alias("low"), F.col("e.d").alias("high"))


def windows(region: DataFrame, s: Settings, reach: float) -> DataFrame:
    """(x, y): pairs of a region, one of them its own, that the windows leave to be tested."""
    x, y = (region.select("key", "cell", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"p{c}"), F.col("low").alias(f"l{c}"), F.col("high").alias(f"h{c}"), F.col("comp").alias(f"c{c}"), F.col("own").alias(f"o{c}")) for c in "xy")
    window = (F.col("lx") - F.col("hy") <= reach) & (F.col("ly") - F.col("hx") <= reach)
    sizes = s.den * F.least("nx", "ny") >= s.num * F.greatest("nx", "ny")
    left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    places = (s.den + s.num) * left >= s.num * (F.col("nx") + F.col("ny"))
    return x.join(y, ["key", "cell"]).where((F.col("x") > F.col("y")) & (F.col("ox") | F.col("oy")) & (F.col("cx") != F.col("cy")) & window & sizes & places).select("x", "y").distinct()


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
