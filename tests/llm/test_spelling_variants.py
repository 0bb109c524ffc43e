"""Spelling variants against all pairs and a plain computation of the query."""

import random
import re
import zlib
from collections import Counter

import pytest

from lexgauge.llm import queries, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=2):
    """All pairs: words that differ by one edit share what is left when one letter is taken out of the longer, or of both."""
    rest = {}
    for w in counts:
        for i in range(len(w) + 1):
            rest.setdefault(w[:i] + w[i + 1 :] if i < len(w) else w, set()).add(w)
    near = {w: set() for w in counts}
    for group in rest.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o.encode()), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def table(spark, counts, tmp_path):
    path = (tmp_path / "words").as_uri()
    spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("split", [3, 4096])
def test_against_all_pairs(spark, tmp_path, split):
    """Short words over few letters, so that regions are large and split; runs of one letter; code points beyond the first plane; long words."""
    r = random.Random(split)
    words = {"".join(r.choice("abé") for _ in range(r.randint(3, 8))) for _ in range(400)}
    words |= {"a" * n for n in range(3, 12)} | {"𝒜𝒷𝒸", "𝒜𝒷𝒸d", "𝒜𝒷x", "x" * 5000, "x" * 5001, "x" * 2500 + "y" + "x" * 2499}
    counts = {w: r.choice([1, 2, 3, 5, 8, 100, 1000]) for w in words}
    got = spelling_variants.variants(table(spark, counts, tmp_path), region_words=split)
    assert {tuple(x) for x in got.collect()} == plain(counts) and got.count() == len(counts)


def test_chain_of_forms(spark, tmp_path):
    word = "abcdefghijklmnop"
    counts = {word[: 3 + i]: 2**i for i in range(13)}
    got = {x.word: x for x in spelling_variants.variants(table(spark, counts, tmp_path)).collect()}
    assert {x.root for x in got.values()} == {word[:15]} and got["abc"].form == "abcd"


def test_edge_cases(spark, tmp_path):
    empty = spelling_variants.variants(table(spark, {"abc": 1}, tmp_path).where("false"))
    assert empty.count() == 0
    with pytest.raises(ValueError):
        spelling_variants.variants(empty, ratio=1)
    rows = [(1, None, "k"), (None, "Aé b2c", "k"), (2, "", "k"), (3, "×÷ ÀX", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert sorted(x.word for x in spelling_variants.misspelt_words(docs).collect()) == sorted(["aé", "b", "c", "×÷", "Àx"])


def words_of(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_op12_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(words_of(docs))
    got = queries.QUERIES["op12_spelling_variants"](spark, sf).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert sum(x.form is not None for x in got) > 20


def test_bound_keeps_all_edits():
    """Words one edit apart share at least the bound of positional grams, at the allowed positions."""
    r = random.Random(1)
    for _ in range(2000):
        a = "".join(r.choice("ab") for _ in range(r.randint(3, 9)))
        i, c = r.randint(0, len(a)), r.choice("abc")
        b = a[:i] + c + a[i + (r.random() < 0.5 and i < len(a)) :]
        if a != b:
            region = spelling_variants.Region([b])
            assert [x for x, _ in region.near(a)] == [0]
