"""Shared byte strings against a plain computation, with small buckets, windows and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from lexgauge.llm import queries, run_index, shared_spans


def plain(rows, length):
    """(id, text) rows to the bytes kept and the removed runs of each row."""
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for a in range(len(b) - length + 1):
                w = b[a : a + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for a in range(len(b) - length + 1):
                if first[b[a : a + length]] < i:
                    gone[a : a + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((i, t, bytes(np.frombuffer(b, np.uint8)[~gone]), [tuple(x) for x in edges.reshape(-1, 2).tolist()]))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "", r[2], r[3])


def found(df):
    return sorted(((r.doc_id, r.text, bytes(r.kept), [(x.start, x.end) for x in r.removed]) for r in df.collect()), key=key)


def corpus(seed, n=60):
    """Texts with shared passages of all lengths around the bound, near copies, runs of one character and many variants of one passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(6, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 20)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            p = p[a : a + r.randint(20, len(p))]
            if r.random() < 0.3:
                at = r.randint(0, len(p))
                p = p[:at] + r.choice("xyz") + p[at:]
            parts += [p, " ".join(word() for _ in range(r.randint(0, 8)))]
        rows.append((r.randint(0, n), "".join(parts)))
    rows += [(i + 200, f"{'.' * r.randint(0, 40)}{passages[0][:30]}{r.choice('pqrst')}{passages[0][30:]}") for i in range(25)]
    rows += [(300, "a" * 400), (301, "a" * 130), (302, "b" + "a" * 49 + "b"), (303, "a" * 50), (None, passages[1] * 2), (None, None), (5, None), (6, ""), (6, "x"), (7, rows[3][1]), (8, rows[3][1]), (rows[4][0], rows[4][1]), (rows[4][0], rows[5][1])]
    return rows


@pytest.mark.parametrize(("seed", "length", "buckets"), [(1, 50, 1 << 28), (2, 50, 0), (3, 26, 1 << 28)])
def test_against_plain_computation(spark, seed, length, buckets):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(shared_spans.strip_shared(df, length, bucket_bytes=buckets, part_bytes=2000))
    assert got == sorted(plain(rows, length), key=key)
    assert sum(len(r[3]) for r in got) > 30


def test_many_variants_of_one_passage(spark):
    """All strings of one anchor differ, so ranks go up to hundreds and every level of bits has matches."""
    r = random.Random(9)
    core = "".join(chr(r.randint(97, 122)) for _ in range(24))
    rows = []
    for i in range(300):
        left = "".join(r.choice("ab") for _ in range(r.randint(0, 26)))
        rows.append((i, left + core + "".join(r.choice("ab") for _ in range(r.randint(0, 26)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(shared_spans.strip_shared(df, 32)) == sorted(plain(rows, 32), key=key)


def test_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept string, unit long, spans int, digest string")
    out = shared_spans.strip_shared(none)
    assert out.count() == 0 and set(out.columns) == {"doc_id", "text", "unit", "spans", "digest", "kept", "removed"}
    long = "lorem ipsum dolor sit amet " * 8000
    rows = [(1, long, "k", 1, 2, "d"), (2, long, "k", 1, 2, "d"), (2, long, "k", 1, 2, "d"), (3, "x" + long, None, None, None, None), (4, "short", "k", 1, 2, "d"), (5, "short", "k", 1, 2, "d")]
    df = spark.createDataFrame(rows, none.schema)
    got = {(r.doc_id, len(r.kept), len(r.removed), r.unit) for r in shared_spans.strip_shared(df).collect()}
    assert got == {(1, len(long), 0, 1), (2, 0, 1, 1), (3, 1, 1, None), (4, 5, 0, 1), (5, 5, 0, 1)}
    with pytest.raises(ValueError):
        shared_spans.strip_shared(df, 20)


def test_op11_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted((i, len((t or "").encode()), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for i, t, kept, runs in plain(rows, 50))
    assert sorted(map(tuple, queries.QUERIES["op11_run_index"](spark, sf).collect())) == expected


def test_matching_statistics():
    r = random.Random(3)
    for letters in (2, 3, 40, 400):
        strings = [[r.randint(1, letters) for _ in range(r.randint(0, 50))] for _ in range(20)]
        strings += strings[:7]
        index = run_index.RunIndex(np.array([x for s in strings for x in [*s, 0]]))
        patterns = sorted([p for p in [*strings[:9], *[[r.randint(1, letters + 1) for _ in range(5)] + r.choice(strings)[:20] for _ in range(9)]] if p], key=len, reverse=True)
        width, sizes = len(patterns[0]), np.array([len(p) for p in patterns])
        matrix = np.array([[-1] * (width - len(p)) + p for p in patterns])
        held = {tuple(s[a:b]) for s in strings for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for t, live, lengths in index.matching_statistics(matrix, sizes):
            for i in range(live):
                rest = patterns[i][len(patterns[i]) - 1 - t :]
                assert lengths[i] == max(n for n in range(len(rest) + 1) if not n or tuple(rest[:n]) in held)


def test_buckets_are_even_and_messages_few(spark, monkeypatch):
    """Anchors' hashes are the smallest of many, so most share their leading bits; the bucket must not come from these."""
    r = random.Random(4)
    passages = [" ".join(str(r.randint(0, 9999)) for _ in range(60)) for _ in range(80)]
    rows = [(i, f"{r.random()}{r.choice(passages)}{r.random()}{r.choice(passages)}") for i in range(400)]
    sizes, written = {}, shared_spans._written

    def spy(spark, df, label):
        out = written(spark, df, label)
        if label == "places":
            sizes.update(out.where("bucket is not null").groupBy("bucket").sum("n").collect())
        return out

    monkeypatch.setattr(shared_spans, "_written", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(shared_spans.strip_shared(df, part_bytes=5000)) == sorted(plain(rows, 50), key=key)
    assert len(sizes) > 32 and max(sizes.values()) < 4 * sum(sizes.values()) / len(sizes)
    small, large = (shared_spans.parts_for(n << 30, 4 << 20) for n in (1, 10))
    assert small == 256 and large <= 1024  # messages between parts and buckets: the square


def test_pieces_of_a_bucket(monkeypatch):
    """A bucket's marks do not depend on how its anchors are dealt into pieces, nor on how many strings one anchor has."""
    r = random.Random(5)
    core = "".join(r.choice("abcdefgh") for _ in range(40))
    texts = ["".join(r.choice("ab") for _ in range(30)) + core[: r.randint(24, 40)] + "".join(r.choice("ab") for _ in range(30)) for _ in range(200)]
    texts += [r.choice(texts)[:60] + "".join(r.choice("abc") for _ in range(60)) for _ in range(200)]
    column = pa.array(texts, pa.large_string())
    units = pa.table({"unit": pa.array(range(400), pa.int64()), "first_id": pa.array(range(400), pa.int64()), "text": column})
    data, ends = shared_spans._slice_bytes(column)
    p, h = shared_spans.anchors(data, ends, 50)
    asked = pa.table({"units": [np.searchsorted(ends, p, side="right").astype(np.int64).tobytes()], "keys": [h.tobytes()]})
    places = shared_spans._find_places(50, 2)(units, asked)
    expected = {(i, a) for i, t in enumerate(texts) for a in range(len(t) - 49) if any(t[a : a + 50] in s for s in texts[:i])}
    for piece in (1 << 16, 20):
        monkeypatch.setattr(shared_spans, "PIECE", piece)
        marks = [places.filter(pa.compute.is_null(places["bucket"]))]
        marks += [shared_spans._marks_of_bucket(50, 2)(places.filter(pa.compute.equal(places["bucket"], b))) for b in (0, 1)]
        spans = [(u, *x) for m in marks for us, xs in zip(m["units"].to_pylist(), m["spans"].to_pylist()) for u, x in zip(np.frombuffer(us, np.int64).tolist(), np.frombuffer(xs, np.int32).reshape(-1, 2).tolist())]
        assert {(u, c) for u, a, b in spans for c in range(a, b - 49)} == expected and len(expected) > 1000
