"""Conversation repair against a plain computation and against all edit scripts of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexgauge.llm import queries, role_repair

WHITE = " \t\n\v\f\r"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def least(rows):
    """The least (cost, audit) with the repaired rows, by whole strings for each state of the pattern."""
    rows = faults(rows)
    best = {"": (0, "", ())}  # state: what the last role was

    def take(d, state, new):
        if state not in d or new[:2] < d[state][:2]:
            d[state] = new

    def insert(d):
        for _ in range(4):
            for state, (c, a, out) in list(d.items()):
                for role in ("user", "assistant"):
                    if (role == "user") == (state in ("", "s", "a")):
                        take(d, role[0], (c + 5, a + "I", (*out, (role, ""))))
        return d

    for role, text, fault in rows:
        new = {}
        for state, (c, a, out) in insert(best).items():
            take(new, state, (c + 2, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            for to, cost, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                i = to[:1]
                if i == "s" and state == "" or i == "u" and state in ("", "s", "a") or i == "a" and state == "u":
                    take(new, i, (c + cost + extra, a + letter, (*out, (to, text))))
        best = new
    ends = insert(best)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])


def scripts(rows):
    """The least (cost, audit) over all edit scripts with at most two insertions."""
    rows, found = faults(rows), []
    for edits in itertools.product("KDua", repeat=len(rows)):
        for n in range(3):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for made in itertools.product("ua", repeat=n):
                    cost, audit, roles = 0, "", ""
                    for i in range(len(rows) + 1):
                        for p, m in zip(places, made):
                            if p == i:
                                cost, audit, roles = cost + 5, audit + "I", roles + m
                        if i == len(rows):
                            break
                        e, (role, _, fault) = edits[i], rows[i]
                        if e == "D":
                            cost, audit = cost + 2, audit + "D"
                            continue
                        if fault in ("blank", "duplicate"):
                            cost = 10**6
                        cost += (e != "K") + (5 if fault else 0)
                        audit, roles = audit + ("K" if e == "K" else "R"), roles + ((role[:1] or "?") if e == "K" else e)
                    if GOOD.fullmatch(roles):
                        found.append((cost, audit))
    return min(found)


def make(r, n):
    texts = ["Yes.", "No!", "open end", " ", "", "Why?  \n", "Yes. "]
    return [(r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), r.choice(texts) if r.random() < 0.5 else f"Number {r.randint(0, 10**6)}.") for _ in range(n)]


def test_plain_computation_is_least():
    r = random.Random(5)
    for _ in range(60):
        rows = make(r, r.randint(0, 4))
        assert least(rows)[:2] == scripts(rows)


def expected(rows):
    """Rows (conv, turn, role, text) to a dict of summaries, audits and repaired rows."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv, held in by.items():
        held.sort(key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).digest()))
        turns = [t for there, t, _, _ in held if there]
        plain = [(r, t) for *_, r, t in held]
        marks = [f for _, _, f in faults(plain)]
        cost, audit, repaired = least(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def found(rows_df, **more):
    edits, summary = role_repair.repair_conversations(rows_df, **more)
    both = {r.conv: r for r in role_repair.digests(edits).collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, both[r.conv].audit, both[r.conv].repaired_sha256) for r in summary.collect()}


@pytest.mark.parametrize("bits", [2])
def test_against_plain_computation(spark, bits):
    """Short and long conversations, nulls, ties, repeated rows; blocks of four rows."""
    r = random.Random(bits)
    rows = []
    for conv in range(60):
        rows += [(conv, i if r.random() < 0.9 else r.choice([None, 3]), *x) for i, x in enumerate(make(r, r.randint(1, 9)))]
    rows += [(100, i, *x) for i, x in enumerate(make(r, 150))]
    rows += [(101, 1, "user", "Again.")] * 40 + [(101, 2, "assistant", "Done.")]
    rows += [(None, None, None, None), (None, 1, "user", "A."), (None, 2, "assistant", None), (102, None, "user", None), (103, 5, "system", "S.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(df, block_bits=bits) == expected(rows)


def test_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, pos long, edit string, conv string"
    edits, summary = role_repair.repair_conversations(spark.createDataFrame([], schema))
    assert edits.count() == 0 and summary.count() == 0 and role_repair.digests(edits).count() == 0
    long = "word " * 60_000 + "."
    rows = [(1, 1, "user", long, 5, "x", "y"), (1, 2, "user", long, 5, "x", "y"), (1, 3, "assistant", long, 5, "x", "y")]
    edits, summary = role_repair.repair_conversations(spark.createDataFrame(rows, schema))
    assert [(r.edit, r.role, len(r.text)) for r in edits.orderBy("pos", "sub").collect()] == [("K", "user", len(long)), ("D", "user", len(long)), ("K", "assistant", len(long))]
    assert summary.first().cost == 2
    with pytest.raises(ValueError):
        role_repair.Chart(costs=role_repair.Costs(insert=0))


def test_insertions_come_with_their_roles(spark):
    rows = [(1, 1, "user", "A."), (1, 2, "assistant", "B."), (1, 3, "user", "C."), (2, 1, "assistant", "D.")]
    dear = role_repair.Costs(delete=50)
    edits, _ = role_repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), costs=dear)
    got = [(r.conv, r.edit, r.role, r.text) for r in edits.orderBy("conv", "pos", "sub").collect()]
    assert got == [(1, "K", "user", "A."), (1, "K", "assistant", "B."), (1, "K", "user", "C."), (1, "I", "assistant", ""), (2, "I", "user", ""), (2, "K", "assistant", "D.")]


def test_op13_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows, ids = [], set()
    for conv, turn, role, text in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        ids.add(conv)
        case = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        rows += [(conv, turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    want = {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for i in ids} | expected(rows)
    got = queries.QUERIES["op13_role_repair"](spark, sf).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(ids)
