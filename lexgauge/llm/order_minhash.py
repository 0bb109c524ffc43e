"""Order MinHash fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

K = 3  # words of a k-mer
ENTRIES = 64  # of a fingerprint
WORD = r"\S{1,32}"  # longer runs count as several words, so that text without spaces has order too


def _let(value: Column, body) -> Column:
    """``body(value)``, evaluating ``value`` once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def order_minhash(text: Column, k: int = K, entries: int = ENTRIES) -> Column:
    """array<long>: the Order MinHash signature (tuples of two) of a text, null taken as empty.

    Each k-mer is numbered by its occurrence, so a repeated k-mer counts each time.
    ``entries`` hash functions are the rotations of one 64-bit hash: under rotation
    b the minimal numbered k-mers are the first ones at or after the start of hash
    range b, going round.  The two minimal ones are put into the order they have in
    the text and hashed together, so an entry agrees only if both k-mers occur in
    both texts in the same order.

    Equal texts have equal signatures.  Texts of fewer than k words are one k-mer;
    texts without words (empty, null, white space) share one signature.
    """
    bits = entries.bit_length() - 1
    if 1 << bits != entries:
        raise ValueError("entries must be a power of two")

    def kmers(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        runs = lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, whole).otherwise(_let(hashes, runs))

    def numbered(h: Column) -> Column:
        """struct(hash of k-mer and occurrence, place, k-mer), in order of the hash."""
        first = F.transform(h, lambda x, i: F.struct(F.xxhash64(x, F.lit(1)).alias("r"), i.alias("p"), x.alias("x")))
        plain = F.size(F.array_distinct(h)) == F.size(h)
        return F.sort_array(F.when(plain, first).otherwise(_let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("p")))), occurrences)))

    def occurrences(s: Column) -> Column:
        """Number equal k-mers of a sorted array: each one's place less that of its run's first.

        The runs' first places come from a running maximum by doubling steps, over
        the repeated k-mers only.
        """
        again = F.filter(F.transform(s, lambda e, i: F.struct(e["x"].alias("x"), e["p"].alias("p"), (F.get(s, i - 1)["x"] == e["x"]).alias("again"))), lambda e: F.coalesce(e["again"], F.lit(False)))
        once = F.filter(F.transform(s, lambda e, i: F.struct(e["x"].alias("x"), e["p"].alias("p"), (F.get(s, i - 1)["x"] == e["x"]).alias("again"))), lambda e: ~F.coalesce(e["again"], F.lit(False)))

        def number(d: Column) -> Column:
            start = F.transform(d, lambda e, i: F.when(F.coalesce(F.get(d, i - 1)["x"] == e["x"], F.lit(False)), F.lit(0)).otherwise(i))
            steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(d) + F.lit(1))).cast("int"))
            runs = F.aggregate(steps, start, lambda acc, s: F.transform(acc, lambda x, i: F.greatest(x, F.coalesce(F.get(acc, i - F.pow(F.lit(2), s).cast("int")), F.lit(0)))))
            return _let(runs, lambda q: F.transform(d, lambda e, i: F.struct(F.xxhash64(e["x"], i - F.get(q, i) + 2).alias("r"), e["p"].alias("p"), e["x"].alias("x"))))

        singles = F.transform(once, lambda e: F.struct(F.xxhash64(e["x"], F.lit(1)).alias("r"), e["p"].alias("p"), e["x"].alias("x")))
        return F.concat(singles, _let(again, number))

    def bucket(e: Column) -> Column:
        """Of a hash, its range from 0 to entries - 1 in signed order."""
        return (F.shiftright(e["r"], 64 - bits) + (entries // 2)).cast("int")

    def signature(s: Column) -> Column:
        # s holds at least one k-mer; entry b belongs to the first one in range b or later, going round
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (bucket(F.get(s, i)) != bucket(F.get(s, F.greatest(i - 1, F.lit(0))))))

        def pair(i: Column) -> Column:
            a, b = F.get(s, i), F.get(s, F.pmod(i + 1, F.size(s)))
            return F.when(a["p"] <= b["p"], F.xxhash64(a["x"], b["x"])).otherwise(F.xxhash64(b["x"], a["x"]))

        def spread(f: Column) -> Column:
            low = lambda j: F.when(j == 0, F.lit(-1)).otherwise(bucket(F.get(s, F.get(f, F.greatest(j - 1, F.lit(0))))))
            filled = F.flatten(F.transform(f, lambda i, j: F.array_repeat(pair(i), bucket(F.get(s, i)) - low(j))))
            return F.concat(filled, F.array_repeat(pair(F.lit(0)), F.lit(entries) - 1 - bucket(F.get(s, F.element_at(f, -1)))))

        return _let(firsts, spread)

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    empty = F.array_repeat(F.lit(0).cast("bigint"), entries)
    done = _let(words, kmers)
    return _let(done, lambda h: F.when(F.size(h) == 0, empty).otherwise(_let(numbered(h), signature)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits an entry."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", order_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Add ``next_<column>``: the value in the next row by descending id; after the last comes the first.

    Ids are cut at quantiles that are ids of the table, so a bucket's first row is
    known beforehand, and that row goes to the preceding bucket as well: one shuffle
    brings all rows next to their successor, and no task gets more than its bucket.
    Rows of equal id are ordered by ``order_col``; rows without an id come last.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n + 1)], 20 * n).alias("m"), F.max(id_col).alias("top"), F.max(F.col(id_col).isNull()).alias("no_id")).first()
    cuts = sorted({*(marks["m"] or []), *([marks["top"]] if marks["top"] is not None else [])})  # at most n + 1 numbers
    kind = docs.schema[id_col].dataType
    at = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(f"array<{kind.simpleString()}>")
    # bucket j holds the ids above cut j - 1, up to cut j; rows without an id go to bucket -1, after all others
    bucket = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.size(F.filter(at, lambda c: c < F.col(id_col))))
    last = F.lit(-1 if marks["no_id"] else 0)
    heads = F.when(F.col(id_col) == F.lit(cuts[-1]).cast(kind), last) if cuts else F.lit(-1)
    copies = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("copy")))
    if cuts:
        # the first row of bucket j follows the last of bucket j + 1; the very first follows the very last
        after = F.when(F.col(id_col) == F.lit(cuts[-1]).cast(kind), F.array(F.struct(last.alias("b"), F.lit(2).alias("copy"))))
        inner = F.when(F.array_contains(at, F.col(id_col)) & (F.col(id_col) != F.lit(cuts[-1]).cast(kind)), F.array(F.struct((bucket + 1).alias("b"), F.lit(1).alias("copy"))))
        none = F.array().cast("array<struct<b:int,copy:int>>")
        copies = F.concat(copies, F.coalesce(after, none), F.coalesce(inner, none))
    else:
        copies = F.array(*[F.struct(heads.alias("b"), F.lit(c).alias("copy")) for c in (0, 2)])
    rows = docs.withColumn("__at", F.explode(copies))
    if marks["no_id"] and cuts:  # the first row without an id follows the smallest id
        lead_in = docs.where(F.col(id_col).isNull()).orderBy(order_col).limit(1).withColumn("__at", F.struct(F.lit(0).alias("b"), F.lit(1).alias("copy")))
        rows = rows.unionByName(lead_in)
    from pyspark.sql import Window

    w = Window.partitionBy("__at.b").orderBy("__at.copy", F.col(id_col).desc_nulls_last(), F.col(order_col).asc_nulls_first())
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(F.col("__at.copy") == 0).drop("__at")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, signature, next_text, next_signature) of each row, in DataFrame functions alone."""
    own = docs.select(F.col(id_col), whole_text(text_col).alias("text")).withColumn("signature", order_minhash(F.col("text")))
    return with_next(own, ["text", "signature"], id_col)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint_documents(documents(spark, sf_dir))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "signature", "next_signature", order_minhash(F.col("edited")).alias("edited_signature"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
