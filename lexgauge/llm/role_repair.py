"""Repair of conversations by error-correcting Earley parsing over a weighted role grammar.

The grammar is right-linear: a production names a role and what follows, or nothing.  Error
productions stand beside each: a row under another role (rerole), a role without a row (insert),
a row without a role (delete).  A set of the chart holds, for each nonterminal predicted there,
the least (cost, audit) that leads to it; its items are that nonterminal's productions with the
dot in front.  Scanning a row moves the dot over the role and predicts what follows, so a set has
as many entries as there are nonterminals, however long the conversation.  An item completes
when the end completes; the completed chart is walked back and gives the repair.

Audits are compared by rank: all entries of a set have consumed the same rows, each row's
letters end with the first one that consumes it, so the order of two audits is that of the
first row where they differ.  What a step does depends only on the entries' costs and ranks
relative to each other and on the row's kind, so steps are kept and used again.

Rows are parsed in blocks of a global order, so a conversation may be as long as it likes: a block
that a conversation enters from another one is parsed from each nonterminal, and the blocks'
results are joined in order, least (cost, audit) first.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, lean_table, materialize, scratch

#: The first nonterminal is the start.
DIALOGUE = {
    "Dialogue": [("system", "Turns"), ("user", "Reply"), None],
    "Turns": [("user", "Reply")],
    "Reply": [("assistant", "Next")],
    "Next": [("user", "Reply"), None],
}
DETAIL = re.compile(r"[^A-Z]")
TOKEN = re.compile(r"(?:I.)*(?:K|D|R.)")


@dataclass(frozen=True)
class Costs:
    """What edits cost; ``truncated`` is added to a truncated row that is not deleted.  An insertion has to cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    makes: tuple[str, ...] = ("user", "assistant")  # roles that rerole and insert give


def audit_of(detail: str) -> str:
    """Initials of the edits: without the role that follows each rerole and insert."""
    return DETAIL.sub("", detail)


@dataclass
class Chart:
    """The grammar with its error productions.  A set is a tuple of (cost, rank) or None by nonterminal, costs from 0 and ranks dense."""

    grammar: dict = field(default_factory=lambda: DIALOGUE)
    costs: Costs = Costs()

    def __post_init__(self):
        if self.costs.insert <= 0:
            raise ValueError("an insertion has to cost something")
        self.names = list(self.grammar)
        at = {n: i for i, n in enumerate(self.names)}
        self.rules = [[(r[0], at[r[1]]) for r in self.grammar[n] if r] for n in self.names]
        self.ends = [None in self.grammar[n] for n in self.names]
        self.initials = {r[:1] for rules in self.rules for r, _ in rules}
        self.known: dict = {}

    def entry(self, i: int = 0):
        return tuple((0, 0) if j == i else None for j in range(len(self.names)))

    def inserted(self, entries):
        """Predict through insertions: by nonterminal the least (cost, rank, letters, detail, from)."""
        best = [None if e is None else (e[0], e[1], "", "", i) for i, e in enumerate(entries)]
        changed = True
        while changed:
            changed = False
            for x, b in enumerate(list(best)):
                for role, y in self.rules[x] if b else ():
                    if role in self.costs.makes:
                        new = (b[0] + self.costs.insert, b[1], b[2] + "I", b[3] + "I" + role[0], b[4])
                        if best[y] is None or new[:3] < best[y][:3]:
                            best[y], changed = new, True
        return best

    def step(self, entries, kind):
        """Scan a row of a kind (initial, has to go, truncated): (next set, cost to add, by nonterminal (from, detail))."""
        got = self.known.get((entries, kind))
        if got:
            return got
        initial, goes, truncated = kind
        best: list = [None] * len(self.names)

        def offer(y, b, cost, letter, detail):
            new = (b[0] + cost, b[1], b[2] + letter, b[3] + detail, b[4])
            if best[y] is None or new[:3] < best[y][:3]:
                best[y] = new

        extra = self.costs.truncated if truncated else 0
        for x, b in enumerate(self.inserted(entries)):
            if b is None:
                continue
            offer(x, b, self.costs.delete, "D", "D")
            if goes:
                continue
            for role, y in self.rules[x]:
                if role[:1] == initial:
                    offer(y, b, extra, "K", "K")
                if role in self.costs.makes:
                    offer(y, b, self.costs.rerole + extra, "R", "R" + role[0])
        ranks = {k: i for i, k in enumerate(sorted({(b[1], b[2]) for b in best if b}))}
        base = min(b[0] for b in best if b)
        got = tuple(b and (b[0] - base, ranks[b[1], b[2]]) for b in best), base, [b and (b[4], b[3]) for b in best]
        if len(self.known) > 20_000:
            self.known.clear()
        self.known[entries, kind] = got
        return got

    def end(self, entries):
        """Complete: (cost to add, from, detail of the last insertions)."""
        done = [b for x, b in enumerate(self.inserted(entries)) if b and self.ends[x]]
        best = min(done, key=lambda b: b[:3])
        return best[0], best[4], best[3]

    def parse(self, kinds, entries):
        """(last set, base cost, steps back) over rows."""
        back, base = [], 0
        for kind in kinds:
            entries, more, steps = self.step(entries, kind)
            base += more
            back.append(steps)
        return entries, base, back

    @staticmethod
    def walk(back, x):
        """Where a nonterminal of the last set began, and the rows' details."""
        out = []
        for steps in reversed(back):
            x, detail = steps[x]
            out.append(detail)
        return x, out[::-1]


PARSED = "conv long, block long, whole boolean, rows array<long>, details array<string>, cost long, illegal long, first string, last string, entry array<int>, exit array<int>, costs array<long>, paths array<string>"
_PARSED = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("rows", pa.list_(pa.int64())), ("details", pa.list_(pa.string())), ("cost", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("entry", pa.list_(pa.int32())), ("exit", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("paths", pa.list_(pa.string()))])


def _parse_block(chart: Chart, legal: frozenset, bits: int):
    """Conversations of a block of rows: whole ones are repaired, those at its borders leave a table of entries and exits."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos").to_pydict()
        conv, initial, out, a = rows["conv"], rows["initial"], [], 0
        kinds = [(i if i in chart.initials else "", g, t) for i, g, t in zip(initial, rows["goes"], rows["truncated"])]
        while a < len(conv):
            b = a
            while b < len(conv) and conv[b] == conv[a]:
                b += 1
            illegal = sum(x + y not in legal for x, y in zip(initial[a:b], initial[a + 1 : b])) + sum(n - 1 for n in rows["copies"][a:b])
            row = {"conv": conv[a], "block": rows["pos"][a] >> bits, "rows": rows["row"][a:b], "illegal": illegal, "whole": a > 0 and b < len(conv), "first": initial[a], "last": initial[b - 1]}
            if row["whole"]:
                last, base, back = chart.parse(kinds[a:b], chart.entry())
                more, x, tail = chart.end(last)
                details = chart.walk(back, x)[1]
                details[-1] += tail
                row |= {"details": details, "cost": base + more}
            else:
                found = []
                for e in range(len(chart.names)):
                    last, base, back = chart.parse(kinds[a:b], chart.entry(e))
                    found += [(e, x, base + v[0], "".join(chart.walk(back, x)[1])) for x, v in enumerate(last) if v]
                row |= dict(zip(("entry", "exit", "costs", "paths"), map(list, zip(*found))))
            out.append(row)
            a = b
        return pa.Table.from_pylist(out, schema=_PARSED)

    return lean_table(run)


def _join_blocks(chart: Chart, legal: frozenset):
    """A conversation's blocks in order, from their tables."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.sort_by("block").to_pylist()
        entries, base, back = chart.entry(), 0, []
        for b in blocks:
            best: list = [None] * len(chart.names)
            for e, x, cost, path in zip(b["entry"], b["exit"], b["costs"], b["paths"]):
                if entries[e]:
                    new = (entries[e][0] + cost, entries[e][1], audit_of(path), path, e)
                    if best[x] is None or new[:3] < best[x][:3]:
                        best[x] = new
            ranks = {k: i for i, k in enumerate(sorted({v[1:3] for v in best if v}))}
            low = min(v[0] for v in best if v)
            entries, base = tuple(v and (v[0] - low, ranks[v[1:3]]) for v in best), base + low
            back.append([v and (v[4], v[3]) for v in best])
        more, x, tail = chart.end(entries)
        paths = chart.walk(back, x)[1]
        out = []
        for i, (b, path) in enumerate(zip(blocks, paths)):
            details = TOKEN.findall(path)
            if i == len(blocks) - 1:
                details[-1] += tail
            seam = 1 if i and blocks[i - 1]["last"] + b["first"] not in legal else 0
            out.append({"conv": b["conv"], "block": b["block"], "whole": True, "rows": b["rows"], "details": details, "cost": base + more if i == 0 else 0, "illegal": b["illegal"] + seam})
        return pa.Table.from_pylist(out, schema=_PARSED)

    return lean_table(run)


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", grammar: dict | None = None, costs: Costs = Costs(), block_bits: int = 12) -> tuple[DataFrame, DataFrame]:
    """Repair conversations at the least cost; among equal costs the audit that is least in ASCII order.

    Returns (edits, conversations), both read from written tables:

    * edits: ``conv``, ``pos``, ``sub`` (their order), ``edit`` (K keep, R rerole, I insert, D delete), ``times``
      (1, or for D the number of equal rows that go), ``role`` and ``text`` as repaired (as they were, for D).
    * conversations: ``conv``, ``gaps`` (numbers missing between the least and the greatest of
      ``order_col``), ``blank``, ``duplicate``, ``truncated`` (rows by their first fault), ``illegal`` (neighbours whose role
      initials no production allows to follow each other) and ``cost``.

    A blank row holds only ASCII white space; a duplicate repeats an earlier row's role and text; a truncated row's last
    character other than white space is none of ``.!?``.  Blank and duplicate rows have to go.  A row matches a
    role by its first letter.

    Null roles and texts are one space; a null id is a conversation of its own; a null order comes first.  Rows of one
    conversation and equal order are taken by role, then by SHA-256 of the text.  Equal rows are held
    once with their number.  Other columns are dropped, whatever their names.  An empty table gives empty results.
    Blocks have ``2 ** block_bits`` rows.  Conversations may be of any length: no step gathers one's rows in a task, and edits are found block by block.
    """
    spark = rows.sparkSession
    chart = Chart(grammar or DIALOGUE, costs)
    follows = {n: {r[:1] for r, _ in filter(None, rules)} for n, rules in chart.grammar.items()}
    legal = frozenset(r[0][:1] + n for rules in chart.grammar.values() for r in filter(None, rules) for n in follows[r[1]])
    plain = rows.select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{order_col}`").cast("long").alias("turn"), _space(role_col).alias("role"), _space(text_col).alias("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    with scratch(spark) as made:
        held = plain.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
        held = held.withColumns({"row": F.monotonically_increasing_id(), "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "open": ~last.isin(".", "!", "?"), "digest": F.unhex(F.sha2("text", 256))})
        held = materialize(spark, held, "held-turns")
        again = held.groupBy("conv", "role", "digest").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("least")).where("n > 1")
        again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "no_turn", "least")
        late = F.coalesce(F.when(F.col("no_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
        light = held.drop("text").join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
        light = light.select("conv", "turn", "row", "copies", "blank", "role", "digest", (late & ~F.col("blank")).alias("late"), (F.col("open") & ~F.col("blank") & ~late).alias("truncated"))
        order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
        light = light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
        light = materialize(spark, light.drop("digest"), "ordered-turns")
        block = light.select("conv", "row", "pos", "copies", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("late")).alias("goes"), "truncated", F.shiftright("pos", block_bits).alias("block"))
        parsed = materialize(spark, block.groupBy("block").applyInArrow(_parse_block(chart, legal, block_bits), PARSED), "parsed-blocks")
        joined = parsed.where("not whole").groupBy("conv").applyInArrow(_join_blocks(chart, legal), PARSED)
        done = materialize(spark, parsed.where("whole").unionByName(joined), "repaired-blocks")

        facts = light.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("__range"),
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1 + F.col("late").cast("int"))).alias("duplicate"),
            F.sum(F.col("truncated").cast("long")).alias("truncated"),
            F.sum((F.col("copies") - 1) * costs.delete).alias("__more"),
        )
        turns = light.select("conv", "turn").distinct().groupBy("conv").agg(F.count("turn").alias("__turns"))
        paid = done.groupBy("conv").agg(F.sum("cost").alias("__cost"), F.sum("illegal").alias("illegal"))
        same = lambda other, n: F.col("conv").eqNullSafe(other[n])
        turns, paid = turns.withColumnRenamed("conv", "__c1"), paid.withColumnRenamed("conv", "__c2")
        summary = facts.join(turns, same(turns, "__c1")).join(paid, same(paid, "__c2"))
        summary = summary.select("conv", (F.col("__range") - F.col("__turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", (F.col("__cost") + F.col("__more")).alias("cost"))
        summary = materialize(spark, summary, "conversations")

        steps = done.select(F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("details").alias("detail"))).alias("s")).select(F.col("s.row").alias("__row"), F.col("s.detail").alias("detail"))
        at = light.select(F.col("row").alias("__at"), "pos")
        wide = held.join(steps, F.col("row") == F.col("__row")).join(at, F.col("row") == F.col("__at"))
        made_role = lambda letter: F.coalesce(*[F.when(letter == r[0], F.lit(r)) for r in costs.makes])
        own = F.regexp_extract("detail", "(K|D|R.)", 1)
        entry = lambda edit, times, role, text: F.struct(edit.alias("edit"), times.alias("times"), role.alias("role"), text.alias("text"))
        one, empty = F.lit(1).cast("long"), F.lit("")
        inserts = lambda part: F.transform(F.regexp_extract_all(part, F.lit("I(.)"), F.lit(1)), lambda x: entry(F.lit("I"), one, made_role(x), empty))
        kept = entry(F.substring(own, 1, 1), F.when(own == "D", F.col("copies")).otherwise(one), F.when(own.startswith("R"), made_role(F.substring(own, 2, 1))).otherwise(F.col("role")), F.col("text"))
        gone = F.when((own != "D") & (F.col("copies") > 1), F.array(entry(F.lit("D"), F.col("copies") - 1, F.col("role"), F.col("text")))).otherwise(F.array().cast("array<struct<edit: string, times: bigint, role: string, text: string>>"))
        before, after = F.regexp_extract("detail", "^((?:I.)*)", 1), F.regexp_extract("detail", "(?:K|D|R.)((?:I.)*)$", 1)
        edits = wide.select("conv", "pos", F.posexplode(F.concat(inserts(before), F.array(kept), gone, inserts(after))).alias("sub", "e")).select("conv", "pos", "sub", "e.*")
        edits = materialize(spark, edits, "edits")
        made.keep(edits, summary)
    return edits, summary


def _space(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


def digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits' initials in order, and the hash of the repaired ``role:text``, joined by line ends.

    Rows of a task are streamed in order; of a conversation only its audit and the hash's state are held.
    """

    def run(batches):
        now, audit, state, some = None, [], None, False

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(["".join(audit)]), pa.array([state.hexdigest()])], ["conv", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, edit, times, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != now:
                    if state is not None:
                        yield flush()
                    now, audit, state, some = conv, [], hashlib.sha256(), False
                audit.append(edit * times)
                if edit != "D":
                    state.update((("\n" if some else "") + f"{role}:{text}").encode())
                    some = True
        if state is not None:
            yield flush()

    ordered = edits.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos", "sub")
    return ordered.select("conv", "edit", "times", "role", "text").mapInArrow(lean(run), "conv long, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by CRC-32 of ``conv_id:turn`` modulo 20: dropped, emptied, without sentence ends, repeated, or under role user."""
    key = F.concat(_space("conv_id"), F.lit(":"), _space("turn"))
    rows = conversations.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), (F.crc32(key) % 20).alias("__damage")).where("__damage != 0")
    case = F.col("__damage")
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1))).alias("__copy"))
    return rows.drop("__copy")


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations")
    edits, summary = repair_conversations(damage(rows))
    found = digests(edits).withColumnRenamed("conv", "__conv")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
