"""Line deduplication by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, documents, drop_path, materialize, new_path, scratch


@dataclass(frozen=True)
class Settings:
    """The token count and ``depth`` leading tokens lead to a leaf of the tree.

    With ``last_tokens`` a line whose leaf no other text reaches is parsed once more by its
    ``depth`` last tokens, which finds templates that vary in a leading word; not by default,
    as plain sentences that differ in one word would be templates then.

    Within a leaf a line may belong to two templates: to the leaf's own one, made of the
    tokens that ``constant`` of its distinct lines have at a place, if it agrees in all
    of these; and to a group of lines that have the same tokens at the places where
    they share one with any other line of the leaf.  Either kind needs words (no numbers)
    at ``similarity`` of the places outside the path.  A line of nothing but numbers
    there recurs only with the same numbers.

    A template recurs if its lines stand in ``min_docs`` different texts.  Lines of fewer
    than ``min_tokens`` tokens recur only word for word, from ``short_docs`` texts on.
    """

    depth: int = 3
    min_tokens: int = 4
    min_docs: int = 2
    short_docs: int = 10
    constant: float = 0.6
    similarity: float = 0.6
    last_tokens: bool = False
    broadcast_rows: int = 500_000


MASK = "<*>"


def split_tokens(line: Column) -> Column:
    """The tokens between white space; a plain split at spaces where that gives the same."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.split(F.btrim(line, F.lit(" \t\r\f\x0b")), r"\s+")).otherwise(F.split(line, " "))


def masked(line: Column) -> Column:
    """Tokens with a digit become the wildcard ``<*>``; each character is looked at once, however long a token is."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", MASK)).otherwise(line)


def line_key(line: Column, tokens: Column, depth: int) -> Column:
    """Hash of the masked tokens, or of the raw ones if no word follows the leading tokens."""
    numbers = F.element_at(tokens, -1) == MASK  # spares the array of most lines
    no_word = numbers & (F.size(F.array_remove(F.slice(tokens, depth + 1, 1 << 30), MASK)) == 0)
    return F.when(no_word, F.xxhash64(split_tokens(line))).otherwise(F.xxhash64(tokens))


def parsed_lines(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, line_no, n, lead, tail, line_key, line) of each line that is not blank.

    ``lead`` and ``tail`` hash the paths through the tree: token count, then the leading or the last tokens.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    rows = rows.where(F.btrim("line", F.lit(" \t\r\f\x0b")) != "").withColumn("tokens", split_tokens(masked(F.col("line")))).withColumn("n", F.size("tokens"))
    lead, tail = F.xxhash64("n", F.slice("tokens", 1, s.depth)), F.xxhash64("n", F.slice("tokens", F.greatest(F.lit(1), F.col("n") - (s.depth - 1)), s.depth), F.lit("tail"))
    return rows.select("id", "text_key", "line_no", "n", lead.alias("lead"), tail.alias("tail"), line_key(F.col("line"), F.col("tokens"), s.depth).alias("line_key"), "line")


def shared(rows: DataFrame, key: str) -> DataFrame:
    """(leaf): the values of ``key`` that lines of two different texts have."""
    return rows.groupBy(F.col(key).alias("leaf")).agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo != hi").select("leaf")


def candidates(lines: DataFrame, s: Settings) -> DataFrame:
    """(id, text_key, line_no, n, by_tail, leaf, line_key, line): lines of leaves that two different texts reach; no other line can recur."""
    spark = lines.sparkSession
    columns = ["id", "text_key", "line_no", "n", "leaf", "line_key", "line"]

    def leaves(rows: DataFrame, key: str) -> DataFrame:
        return bounded(materialize(spark, shared(rows, key), "line-leaves"), s.broadcast_rows)

    by_lead = leaves(lines, "lead")
    found = lines.join(by_lead, F.col("lead") == F.col("leaf")).select(*columns, F.lit(False).alias("by_tail"))
    if not s.last_tokens:
        return found
    rest = lines.join(by_lead, F.col("lead") == F.col("leaf"), "left_anti").where(F.col("n") > s.min_tokens)
    return found.unionByName(rest.join(leaves(rest, "tail"), F.col("tail") == F.col("leaf")).select(*columns, F.lit(True).alias("by_tail")))


def general_templates(distinct_lines: DataFrame, s: Settings) -> DataFrame:
    """(leaf, line_key, whole, part): the leaf's own template where the line fits it, and the line's group.

    Tokens are counted by (leaf, place, token), so a leaf with very many lines is
    spread over its cells; a line's cells come together by the line.
    """
    written = lambda df, label: bounded(materialize(df.sparkSession, df, label), s.broadcast_rows)
    several = distinct_lines.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1")
    lines = distinct_lines.join(written(several, "line-several"), "leaf")
    outside = F.when(F.col("by_tail"), F.col("pos") < F.col("n") - s.depth).otherwise(F.col("pos") >= s.depth)
    cells = lines.select("leaf", "line_key", "n", "lines", "by_tail", F.posexplode("token_keys").alias("pos", "tok")).where(outside)
    word = F.col("tok") != F.xxhash64(F.lit(MASK))
    counts = cells.groupBy("leaf", "pos", "tok").agg(F.count("*").alias("c"), F.first("lines").alias("lines"))
    counts = counts.select("leaf", "pos", "tok", "c", (F.col("c") >= s.constant * F.col("lines")).alias("constant")).where("c > 1")
    counts = materialize(counts.sparkSession, counts, "line-cells")
    wanted = counts.where("constant").groupBy("leaf").agg(F.count("*").alias("wanted"), F.count_if(word).alias("words"))
    of_line = cells.join(counts, ["leaf", "pos", "tok"]).groupBy("leaf", "line_key").agg(
        F.first("n").alias("n"), F.count_if("constant").alias("met"), F.count_if(word).alias("held"), F.xxhash64(F.array_sort(F.collect_list(F.struct("pos", "tok")))).alias("group")
    )
    enough = lambda c: (F.col(c) > 0) & (F.col(c) >= s.similarity * (F.col("n") - s.depth))
    out = of_line.join(written(wanted, "line-wanted"), "leaf", "left")
    return out.select("leaf", "line_key", F.when((F.col("met") == F.col("wanted")) & enough("words"), F.col("leaf")).alias("whole"), F.when(enough("held"), F.xxhash64("leaf", "group")).alias("part"))


def recurring_lines(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, line_no, template): the lines that belong to a recurring template.

    ``template`` names it: the leaf's own template, else the line's group, else the
    line's own tokens, whichever recurs.  All are counted over all documents, exact
    copies of a text counting once, by aggregations that combine before they
    shuffle, so a line that a third of the rows hold costs one row a task.  Texts are
    parsed once; lines of leaves that one text alone reaches go no further.
    """
    s, spark = settings, docs.sparkSession
    first = new_path(spark, "line-parsed")
    parsed_lines(docs, s, id_col, text_col).write.parquet(first)
    kept = candidates(spark.read.parquet(first), s)
    keys = F.transform(split_tokens(masked(F.col("line"))), lambda t: F.xxhash64(t))
    kept = materialize(spark, kept.select("id", "text_key", "line_no", "n", "by_tail", "leaf", "line_key", F.when(F.col("n") > s.min_tokens, keys).alias("token_keys")), "line-candidates")
    drop_path(spark, first)
    distinct_lines = kept.groupBy("leaf", "line_key").agg(F.first("n").alias("n"), F.first("by_tail").alias("by_tail"), F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.first("token_keys").alias("token_keys"))
    distinct_lines = materialize(spark, distinct_lines, "line-distinct")

    def recurring(rows: DataFrame, key: str, texts: int) -> DataFrame:
        """(key): the templates whose lines stand in so many different texts."""
        if texts <= 2:
            return rows.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi" if texts == 2 else "true").select(key)
        held = kept.select("leaf", "line_key", "text_key").distinct().join(rows.where("lo != hi" if key == "exact" else "true").select("leaf", "line_key", key), ["leaf", "line_key"])
        return held.select(key, "text_key").distinct().groupBy(key).agg(F.count("*").alias("texts")).where(F.col("texts") >= texts).select(key)

    spans = distinct_lines.select("leaf", "line_key", "n", "lo", "hi", F.xxhash64("leaf", "line_key", F.lit("exact")).alias("exact"))
    general = materialize(spark, general_templates(distinct_lines.where(F.col("n") > s.min_tokens), s).join(spans.select("leaf", "line_key", "lo", "hi"), ["leaf", "line_key"]), "line-general")
    exact = recurring(spans.where(F.col("n") >= s.min_tokens), "exact", s.min_docs).unionByName(recurring(spans.where(F.col("n") < s.min_tokens), "exact", s.short_docs))
    named = [spans.join(exact, "exact").select("leaf", "line_key", F.lit(2).alias("rank"), F.col("exact").alias("template"))]
    for rank, kind in enumerate(("whole", "part")):
        some = general.where(F.col(kind).isNotNull())
        named.append(some.join(recurring(some, kind, s.min_docs), kind).select("leaf", "line_key", F.lit(rank).alias("rank"), F.col(kind).alias("template")))
    template = named[0].unionByName(named[1]).unionByName(named[2]).groupBy("leaf", "line_key").agg(F.min(F.struct("rank", "template"))["template"].alias("template"))
    template = bounded(materialize(spark, template, "line-templates"), s.broadcast_rows)
    return kept.select("id", "text_key", "line_no", "leaf", "line_key").join(template, ["leaf", "line_key"]).select("id", "text_key", "line_no", "template")


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines of these numbers: the runs between them, joined."""

    def let(value: Column, body) -> Column:
        """``body(value)``, evaluating ``value`` once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def runs(lines: Column, ends: Column) -> Column:
        after = lambda j: F.coalesce(F.get(ends, j - 1), F.lit(-1)) + 1
        return F.flatten(F.transform(ends, lambda e, j: F.slice(lines, after(j) + 1, e - after(j))))

    return F.array_join(let(F.split(text, "\n"), lambda lines: let(F.concat(F.array_sort(dropped), F.array(F.size(lines))), lambda ends: runs(lines, ends))), "\n")


def dedup_lines(docs: DataFrame, settings: Settings = Settings(), keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns and rows, the recurring templates' lines taken out of the text, and ``n_dropped``.

    With ``keep_first`` the first line of each template stays: that of the smallest
    id, then the smallest line number (so the first copy of a text keeps it all).
    Null texts stay null; a text without a dropped line stays as it is, to the byte;
    one that loses all its lines becomes empty.  Rows of equal id and text are
    treated alike, rows without an id as rows of one id before all others.  Blank lines
    stay.  Whole texts are read, however long they or their lines are, in time that grows
    in proportion.  Intermediate tables are deleted but for the one the result is read from.
    All other columns stay as they are; an existing ``n_dropped`` is replaced.
    """
    spark = docs.sparkSession
    with scratch(spark) as made:
        found = recurring_lines(docs, settings, id_col, text_col)
        if keep_first:
            found = materialize(spark, found, "line-recurring")
            firsts = found.groupBy("template").agg(F.min(F.struct("id", "line_no", "text_key")).alias("first")).select("template", F.col("first.id").alias("id"), F.col("first.line_no").alias("line_no"), F.col("first.text_key").alias("text_key"), F.lit(True).alias("stays"))
            same = found.template.eqNullSafe(firsts.template) & found.id.eqNullSafe(firsts.id) & (found.line_no == firsts.line_no) & (found.text_key == firsts.text_key)
            found = found.join(firsts, same, "left_anti")
        dropped = found.groupBy(F.col("id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("line_no").alias("__lines"))
        dropped = materialize(spark, dropped, "line-dropped")
        made.keep(dropped)
    on = docs[id_col].eqNullSafe(dropped["__id"]) & (F.xxhash64(docs[text_col]) == dropped["__key"])
    out = docs.drop("n_dropped").join(dropped, on, "left")
    kept = [F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("__lines"))).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_dropped"]
    return out.select(*kept, F.coalesce(F.size("__lines"), F.lit(0)).alias("n_dropped"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines_left"), "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
