"""The operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexgauge.llm import audio, bpe_codec, common, graph, jaccard_join, license_scan, line_templates, order_minhash, packing, queries, token_counts, toxicity, url_filter, vocabularies

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor, sit amet " * 4000
ODD = [None, "", "   ", "a", "A\r\nb", LONG, LONG, "日本語 한국어 ΑΣ İ ß ŉ", "x<|endoftext|>y <|startoftext|>", "\x1c\x85 z", "e\u0301 \u2126", "it's we'll 12.5%", "A\r\nb"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a null id, and extra columns with names that the operators use."""
    rows = [(i, t, "x", 1.0, -1) for i, t in enumerate(ODD)] + [(1, "", "x", 1.0, -1), (None, "a", "x", 1.0, -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, score double, n_tokens long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


# 1 ----------------------------------------------------------------------------


def test_counts_match_the_library(spark, odd, docs):
    count = library(BYTE)
    for df in (odd.select("doc_id", "text", "digest", "n_tokens"), docs):
        for r in token_counts.count_tokens(df, BYTE).collect():
            assert r.n_tokens == len(count(r.text))


def test_cache_is_used_and_extended(spark, tmp_path, none):
    cache = (tmp_path / "cache").as_uri()
    a = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.count_tokens(a, BYTE, cache).orderBy("doc_id").collect()] == [2, 2, 0]
    assert spark.read.parquet(cache).count() == 2
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(cache + "2")
    b = a.union(spark.createDataFrame([(4, "three")], a.schema))
    assert [r.n_tokens for r in token_counts.count_tokens(b, BYTE, cache + "2").orderBy("doc_id").collect()] == [77, 77, 77, 1]
    assert spark.read.parquet(cache + "2").count() == 3
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_exotic_characters_agree():
    counter, count = vocabularies.ByteLevelCounter(vocabularies.read_vocabulary(BYTE)[0]), library(BYTE)
    for a in range(0, 0x3000, 97):
        text = "a" + " ".join(chr(c) + chr(c) for c in range(a, a + 97) if not 0xD800 <= c < 0xE000)
        assert counter.count(text) == len(count(text))


# 2 ----------------------------------------------------------------------------


def test_order_minhash_properties(spark, odd):
    df = odd.withColumn("s", order_minhash.order_minhash(F.col("text")))
    rows = df.select("doc_id", "text", "s").collect()
    assert all(len(r.s) == 64 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[" ".join((r.text or "").split()) if r.text != "A\r\nb" else r.text].add(tuple(r.s))
    assert all(len(v) == 1 for v in by.values())


def test_occurrence_numbers_and_order(spark):
    """Against a plain computation of the same definition, with repeated k-mers."""
    text = "a b c a b c a b c d e f a b c d"
    w = text.split()
    h = [r[0] for r in spark.createDataFrame([(x,) for x in w], "w string").select(F.xxhash64("w")).collect()]
    kmers = spark.createDataFrame([(i, h[i], h[i + 1], h[i + 2]) for i in range(len(h) - 2)], "i int, a long, b long, c long").select("i", F.xxhash64("a", "b", "c").alias("x")).orderBy("i").collect()
    seen, rows = Counter(), []
    for r in kmers:
        seen[r.x] += 1
        rows.append((r.i, r.x, seen[r.x]))
    ranked = sorted((r.r, r.i, r.x) for r in spark.createDataFrame(rows, "i int, x long, o int").select(F.xxhash64("x", "o").alias("r"), "i", "x").collect())
    want = []
    for b in range(64):
        start = -(1 << 63) + (b << 58)
        at = next((k for k, e in enumerate(ranked) if e[0] >= start), 0)
        two = sorted([ranked[at], ranked[(at + 1) % len(ranked)]], key=lambda e: e[1])
        want.append((two[0][2], two[1][2]))
    hashed = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(want)], "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    assert spark.createDataFrame([(text,)], "t string").select(order_minhash.order_minhash(F.col("t"))).first()[0] == hashed


def test_order_changes_the_signature(spark):
    import random

    w = [f"w{i}" for i in range(200)]
    swapped = w[100:] + w[:100]
    mixed = random.Random(1).sample(w, 200)
    near = w[:190] + [f"v{i}" for i in range(10)]
    df = spark.createDataFrame([(" ".join(x),) for x in (w, near, swapped, mixed)], "t string").select(order_minhash.order_minhash(F.col("t")).alias("s"))
    s = [r.s for r in df.collect()]
    like = [sum(a == b for a, b in zip(s[0], x)) / 64 for x in s]
    assert like[0] == 1 and like[1] > 0.7 and like[1] > like[2] > like[3] and like[3] < 0.1


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_document(spark, buckets):
    ids = [5, 3, 3, 9, 100, 7, 8, 50, 51, 52, None, None]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    got = {r.text: r.next_text for r in order_minhash.with_next(df, ["text"], buckets=buckets).collect()}
    assert got == want


def test_next_document_of_few(spark, none):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert order_minhash.with_next(df, ["text"]).first().next_text == "a"
    assert order_minhash.with_next(none.select("doc_id", "text"), ["text"]).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert {r.text: r.next_text for r in order_minhash.with_next(nulls, ["text"]).collect()} == {"a": "b", "b": "a"}


def test_edited_text(spark):
    rows = queries.QUERIES["op2_order_minhash"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    follow = dict(zip(order, order[1:] + order[:1]))
    for r in rows:
        t, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + texts[follow[r.doc_id]][:half]).encode()).hexdigest()
        assert r.n_chars == len(t)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


# 3 ----------------------------------------------------------------------------

URLS = ["http://A.Example.NET/en/1?x", "https://net/x", "http://net", "http://notnet/", "ftp://x.org/fr/", "http://x.org/fr", "http://example.com/de/q#f", None, "no scheme", "://", "http://example.net/EN/1", "http://q.example.net/en/?a=/en/", "http://u@net:80/", "x://y://net/"]


def plain_rule(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fit, key=lambda r: (-len(r.name), r.name, r.verdict), default=None)


@pytest.mark.parametrize("most", [200_000, 0])
def test_url_rules(spark, most):
    extra = [url_filter.Rule("a.example.net", "/e", "block"), url_filter.Rule("example.net", "/en", "block"), url_filter.Rule("com", "/de/q/", "allow"), url_filter.Rule("y", "", "block")]
    rules = [*url_filter.RULES, *extra]
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, rules, max_trie_rules=most).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        want = plain_rule(rules, host.lower(), path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host.lower(), path, want and want.name, want.verdict if want else "allow"), u


def test_url_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    theirs = sorted(map(repr, c.execute(f"SELECT {', '.join(names)} FROM ({url_filter.OP3_SQL})").fetchall()))
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op3_url_filter"](spark, SF).select(*names).collect()) == theirs


# 4 ----------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op4_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    hit = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert hit / sum(truth[r.doc_id] for r in rows) > 0.9 and hit / max(1, sum(r.predicted for r in rows)) > 0.9


def test_scores_against_a_plain_computation(spark, docs):
    """Counts, ratios and scores of the trained model, from dictionaries of n-grams."""
    texts = ["you fool you fool", "a kind word", "such a FOOL, fool, fool fool", "kind people", "foolish", "the kind of it"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("fool" in t.lower())) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)

    def grams(t):
        raw = f" {t.lower()} ".encode()
        return Counter(raw[i : i + n] for n in toxicity.ORDERS for i in range(len(raw) - n + 1))

    def place(g):
        h = g[0]
        for c in g[1:]:
            h = (h * 0x01000193 + (c + 1) * 0x9E3779B1) % (1 << 32)
            h ^= h >> 15
        return (h * 0x85EBCA6B) % (1 << 32) >> (32 - toxicity.BITS)

    def plain(t):
        c = Counter()
        for g, n in grams(t).items():
            c[place(g)] += n
        return {int(toxicity.at_level(np.array([g], np.uint32), k)[0]) for g, n in c.items() for k, most in enumerate(toxicity.LEVELS) if n >= most}

    kept = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    for t in [*texts, "", "not seen before fool kind", docs.first().text]:
        assert set(toxicity.features(t).tolist()) == plain(t)
        z = model.bias + sum(float(model.weights[f]) for f in plain(t))
        assert abs(model.score(t) - 1 / (1 + np.exp(-z))) < 1e-6
    n = Counter("fool" in texts[i].lower() for i in kept)
    seen = {y: Counter(f for i in kept if ("fool" in texts[i].lower()) == y for f in plain(texts[i])) for y in (True, False)}
    for f in np.flatnonzero(model.weights):
        ratio = np.log((seen[True][f] + 0.5) / (n[True] + 1)) - np.log((seen[False][f] + 0.5) / (n[False] + 1))
        assert model.weights[f] * ratio > 0
    assert model.score("fool fool") > 0.5 > model.score("kind word")


def test_rows_of_the_fit_are_bounded(spark):
    """One labelled id on very many rows; equal rows count once where rows have to go."""
    docs = spark.createDataFrame([(1, f"text {i % 3000}") for i in range(5000)] + [(i, "other") for i in range(2, 9)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, y long")
    rows = lambda most: toxicity.training_rows(docs, known, toxicity.Settings(max_train_rows=most), "doc_id", "text")
    assert rows(10).count() == 10 and rows(4000).count() == 3007 and rows(6000).count() == 5007


def test_toxicity_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for model in (toxicity.train(odd, labels), toxicity.train(none, labels), toxicity.train(odd, labels.where("false"))):
        rows = toxicity.score_toxicity(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.train(odd, labels.where("false")).score("x") == 0
    assert toxicity.score_toxicity(none, toxicity.Model(0.5)).count() == 0


# 5 ----------------------------------------------------------------------------


def test_codec_round_trip(spark, odd, docs):
    tok = Tokenizer.from_file(WORD)
    for df in (odd, docs.limit(60)):
        texts = [r.text for r in df.collect()]
        encoded = bpe_codec.encode_texts(df, WORD)
        got = sorted(tuple(r.ids) for r in encoded.collect())
        assert got == sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) for t in texts)
        back = sorted(r.text for r in bpe_codec.decode_ids(encoded, WORD).collect())
        assert back == sorted(tok.decode(list(i), skip_special_tokens=False) for i in got)
        digests = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.codec_digests(df, WORD).collect())
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert digests == sorted((len(i), sha(" ".join(map(str, i))), sha(tok.decode(list(i), skip_special_tokens=False))) for i in got)


def test_forced_boundaries():
    bpe = vocabularies.WordEndBPE(vocabularies.read_vocabulary(WORD)[0])
    assert not bpe.inside[bpe.END[0]].any() and bpe.inside[ord("t"), ord("h")]
    tok = library(WORD)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        t = "".join(chr(c) for c in rng.choice([*range(32, 127), 233, 223, 0x3B1, 0x4E00, 0x301, 10, 9], rng.integers(0, 30)))
        assert bpe.encode(t) == tok(t)


def test_memo_stays_bounded():
    bpe = vocabularies.WordEndBPE(vocabularies.read_vocabulary(WORD)[0])
    bpe.memo.entries = 50
    tok = library(WORD)
    for i in range(300):
        t = f"word{i} other{i % 7} word{i // 2}"
        assert bpe.encode(t) == tok(t) and len(bpe.memo) <= 53


# 6 ----------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def chain(n, step, width, start=0):
    """Texts that slide over a word list: neighbours are alike, ends are not."""
    return [" ".join(f"c{j}" for j in range(start + i * step, start + i * step + width)) for i in range(n)]


@pytest.mark.parametrize("settings", [jaccard_join.Settings(), jaccard_join.Settings(k=5, num=80), jaccard_join.Settings(k=2, num=60, rounds=1), jaccard_join.Settings(count_bits=0, broadcast_rows=0), jaccard_join.Settings(k=2, num=60, window_rows=1), jaccard_join.Settings(k=1, num=55, window_rows=0)])
def test_jaccard_components(spark, docs, settings):
    texts = [r.text for r in docs.limit(40).collect()] + chain(30, 2, 60) + chain(25, 12, 60, 5000) + ["", None, " ", "one", "One", "two words", "TWO\twords", LONG, LONG + "end"]
    texts += [" ".join(["same"] * 5 + [f"u{i}"] * 3) for i in range(20)]
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()
    want = brute_components(rows, settings.k, settings.num, settings.den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_edge_cases(spark, odd, none):
    assert jaccard_join.jaccard_components(none).count() == 0
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5} and {r.component_id for r in rows if r.doc_id in (4, 12)} == {4}
    assert [r.component_id for r in rows if r.doc_id is None] == [3]


def test_shared_ids_join_nothing(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(3, one), (3, two), (1, one + " x"), (2, two + " y"), (3, one), (None, two), (None, "alone")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(0, 0), (0, 2), (1, 1), (2, 2), (3, 1), (3, 1), (3, 2)]


def test_scratch_tables_go(spark):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file:")) / "lexgauge"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(chain(20, 2, 60))], "doc_id long, text string")
    out = jaccard_join.jaccard_components(df)
    assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before} == {"jaccard-members", "jaccard-components"}
    assert {r.component_id for r in out.collect()} == {0}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(130, 140), (140, 131), (7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[131] == got[140] == 130
    assert graph.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# 7 ----------------------------------------------------------------------------


def test_line_templates(spark):
    shared = "please visit our site for more of these great offers"
    rows = [(i, f"own line number{'x' * i} of text {chr(97 + i)}{chr(98 + i)} q{'z' * i}\n{shared}\nOrder 10{i} was shipped on day {i} of May\nshort one") for i in range(6)]
    rows += [(6, "a text of its own that nobody repeats"), (7, None), (8, ""), (9, rows[0][1])]
    out = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0].n_dropped == 0
    for i in range(1, 6):
        assert out[i].text.split("\n") == [rows[i][1].split("\n")[0], "short one"] and out[i].n_dropped == 2
    assert out[6].text == rows[6][1] and out[7].text is None and out[8].text == "" and out[7].n_dropped == 0


def test_line_templates_wildcards(spark):
    """Leading tokens and count lead to one leaf; a varying word becomes a wildcard."""
    names = ["anna", "bert", "carl", "dora", "emil"]
    rows = [(i, f"the report was written by {n} on time") for i, n in enumerate(names)] + [(9, "the report was never meant to be read")]
    found = line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.id for r in found) == [0, 1, 2, 3, 4] and len({r.template for r in found}) == 1
    all_gone = line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False)
    assert sorted(r.doc_id for r in all_gone.where("n_dropped = 0").collect()) == [9]


def test_line_of_two_texts(spark):
    """Two different texts are enough for a line to recur; the first place stays."""
    shared = "a long passage that stands word for word in exactly two different texts"
    rows = [(0, f"first text with words of its own\n{shared}"), (1, f"another beginning that no text repeats\n{shared}"), (2, "nothing of this is shared with others")]
    out = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_dropped for i in range(3)] == [0, 1, 0] and out[0].text == rows[0][1] and out[1].text == rows[1][1].split("\n")[0]


def test_leading_tokens_and_numbers_make_no_template(spark):
    """Lines of a leaf that agree in nothing beyond its path, and rows of other numbers, are different lines."""
    rows = [(i, f"it was then {w}") for i, w in enumerate(["dark", "late", "cold", "over"])]
    rows += [(10 + i, f"we went on {a} {b}") for i, (a, b) in enumerate([("up", "hill"), ("by", "car"), ("to", "town")])]
    rows += [(20 + i, f"{i} {i + 1} {i + 2} {i + 3}") for i in range(4)] + [(30, "7 8 9 10"), (31, "a text\n7 8 9 10")]
    rows += [(40 + i, f"it is on page {i} of the {w} book we read") for i, w in enumerate(["red", "old", "new"])]
    found = line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.id for r in found) == [30, 31, 40, 41, 42] and len({r.template for r in found}) == 2


def brute_lines(rows, s):
    """(id, line number) of the lines that recur, by a plain reading of the same definition."""
    parsed = []
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\f\v"):
                raw = line.split()
                parsed.append((i, t, no, [line_templates.MASK if re.search("[0-9]", w) else w for w in raw], raw))
    texts = defaultdict(set)
    for _, t, _, w, _ in parsed:
        texts["lead", len(w), *w[: s.depth]].add(t)
    of_leaf = []
    for i, t, no, w, raw in parsed:
        leaf = ("lead", len(w), *w[: s.depth])
        if len(texts[leaf]) < 2:
            if len(w) <= s.min_tokens or not s.last_tokens:
                continue
            leaf = ("tail", len(w), *w[-s.depth :])
            texts[leaf].add(t)
        key = tuple(raw) if w[-1] == line_templates.MASK and set(w[s.depth :]) <= {line_templates.MASK} else tuple(w)
        of_leaf.append((i, t, no, leaf, key, w))
    of_leaf = [x for x in of_leaf if len(texts[x[3]]) > 1]
    leaves = defaultdict(dict)
    for x in of_leaf:
        leaves[x[3]][x[4]] = x[5]
    names = {}
    for leaf, lines in leaves.items():
        places = range(leaf[1] - s.depth) if leaf[0] == "tail" else range(s.depth, leaf[1])
        counts = Counter((p, w[p]) for w in lines.values() for p in places)
        constant = {c for c, k in counts.items() if k >= s.constant * len(lines) and k > 1}
        enough = lambda cells: 0 < (k := sum(c[1] != line_templates.MASK for c in cells)) and k >= s.similarity * (leaf[1] - s.depth)
        for key, w in lines.items():
            held = {(p, w[p]) for p in places if counts[p, w[p]] > 1}
            names[leaf, key] = [("exact", leaf, key)]
            if leaf[1] > s.min_tokens and len(lines) > 1:
                names[leaf, key] = [("whole", leaf)] * (enough(constant) and constant <= held) + [("part", leaf, tuple(sorted(held)))] * enough(held) + names[leaf, key]
    held = defaultdict(set)
    for _, t, _, leaf, key, _ in of_leaf:
        for name in names[leaf, key]:
            held[name].add(t)
    return {(i, no): name for i, _, no, leaf, key, _ in of_leaf for name in [next((m for m in names[leaf, key] if len(held[m]) >= (s.min_docs if leaf[1] >= s.min_tokens else s.short_docs)), None)] if name}


def test_lines_against_brute_force(spark, docs):
    rng = np.random.default_rng(11)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(120):  # few words and numbers, so that leaves hold several families
        lines = [" ".join(rng.choice(["on", "the", "a", "red", "7", "12"], rng.integers(1, 9))) for _ in range(rng.integers(1, 6))]
        rows.append((10_000 + k, "\n".join(lines)))
    rows += [(20_000 + i, f"tab\there  and  spaces {w}\r\n \t \n{w} ends alike for all of them") for i, w in enumerate(["x", "y", "z"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (line_templates.Settings(), line_templates.Settings(last_tokens=True), line_templates.Settings(min_docs=3, short_docs=4, last_tokens=True, broadcast_rows=0)):
        want = brute_lines(rows, s)
        got = {(r.id, r.line_no): r.template for r in line_templates.recurring_lines(df, s).collect()}
        assert set(got) == set(want) and len(set(got.values())) == len(set(want.values())) == len({(got[k], want[k]) for k in want})
    want, firsts = brute_lines(rows, line_templates.Settings()), {}
    for k in sorted(want):
        firsts.setdefault(want[k], k)
    for r in line_templates.dedup_lines(df).collect():
        lines = (r.text if r.text is None else dict(rows)[r.doc_id]).split("\n")
        gone = {no for no in range(len(lines)) if (r.doc_id, no) in want and firsts[want[r.doc_id, no]] != (r.doc_id, no)}
        assert r.n_dropped == len(gone) and r.text == "\n".join(x for no, x in enumerate(lines) if no not in gone)


def test_families_of_a_leaf(spark):
    """Two templates of one path; short lines need ten texts; a template that varies in its second token is found by its last ones."""
    names = ["anna", "bert", "carl", "dora"]
    rows = [(i, f"we have seen {w} walk along the old river bank today") for i, w in enumerate(names[:3])]
    rows += [(10 + i, f"we have seen how prices of {w} went up since then") for i, w in enumerate(["milk", "salt", "corn"])]
    rows += [(20 + i, f"user {w} has just joined the channel") for i, w in enumerate(names)]
    rows += [(40 + i, f"read more\n{'abcdefghijkl'[i]} alone") for i in range(10)] + [(60 + i, f"see also\n{'abcdefghijkl'[i]} only") for i in range(9)]
    for settings, more in ((line_templates.Settings(), set()), (line_templates.Settings(last_tokens=True), {21, 22, 23})):
        out = {r.doc_id: r.n_dropped for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
        assert {i for i, n in out.items() if n} == {1, 2, 11, 12, *range(41, 50)} | more and max(out.values()) == 1


def test_very_long_lines(spark):
    """One line of 300,000 characters without a space, one of 60,000 words, and 20,000 lines of which most recur."""
    many = "\n".join(f"this line of many is held by {'abcde'[i % 5] * (1 + i % 50)} and others" for i in range(20_000))
    rows = [(1, "x" * 300_000 + " end of it"), (2, "word " * 60_000 + "a1"), (3, "word " * 60_000 + "b2"), (4, many), (5, many + "\nlast words of this one")]
    out = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_dropped == 0 and out[2].n_dropped == 0 and out[3].n_dropped == 1 and out[5].n_dropped == 20_000 and out[5].text == "last words of this one"


def test_copies_count_once(spark, odd, none):
    text = "one line of a text that is copied whole\nand a second line of that same text"
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    assert line_templates.recurring_lines(df).count() == 0
    assert line_templates.dedup_lines(none).count() == 0
    assert line_templates.dedup_lines(odd.withColumn("n_dropped", F.lit("old"))).count() == odd.count()


# 8 ----------------------------------------------------------------------------


def test_audio_round_trip(spark, odd, none):
    rows = audio.audio_columns(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        samples, rate = audio.decode_wav(r.media)
        assert samples == r.payload and rate == 12_000 and len(samples) % 64 == 0 and len(samples) >= 64
        assert samples[r.n_bytes :].strip(b"\0") == b""
        t = audio.read_segments(r.segments)
        assert t.column("log_mel").type.shape == [8, 24] and all(a < b for a, b in zip(t.column("start_ms").to_pylist(), t.column("end_ms").to_pylist()))
        by[bytes(samples)].add(bytes(r.segments))
    assert all(len(v) == 1 for v in by.values())
    assert audio.audio_columns(none).count() == 0


def test_op8_digests(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.QUERIES["op8_audio"](spark, SF).limit(50).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44)


def test_resampling_against_the_definition():
    s = audio.Settings()
    e = audio.Extractor(s)
    x = np.random.default_rng(1).normal(size=200).astype(np.float32)
    h = e.branches.T.ravel()
    up = np.zeros(len(x) * s.up)
    up[:: s.up] = x
    want = np.convolve(up, h)[:: s.down]
    got = audio.resample(x, s.up, s.down, e.branches)
    assert np.allclose(got, want[: len(got)], atol=1e-4)


def test_hysteresis():
    e = audio.Extractor(audio.Settings())
    level = np.array([0, 0, 0, 0, 1, 0.1, 1, 0, -0.3, 0.1, 0, 0, 2, 0.0, 0, 0, -1, 0], np.float32)
    spans = e.segments(np.repeat(level[:, None], 3, axis=1))
    assert spans == [(4, 8), (12, 16)]
    assert audio.decode_wav(b"RIFF" + struct.pack("<I", 36) + audio.encode_wav(b"ab", 8000)[8:])[0] == b"ab"


# 9 ----------------------------------------------------------------------------


def test_license_scan(spark, odd, none):
    text = "intro\nLicensed  under the Apache License, version 2.0\nmore words here\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal in\nthe Software without restriction\nlicensed to kill"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(h.line, h.license) for h in license_scan.scan_licenses(df).first().hits] == [(1, "Apache-2.0"), (3, "MIT")]
    assert all(r.hits == [] for r in license_scan.scan_licenses(odd).collect()) and license_scan.scan_licenses(none).count() == 0


def plain_scan(text, templates, t):
    """All windows of the text against all templates, without bounds."""
    w = license_scan.words(text)
    pairs, found = list(zip(w, w[1:])), []
    for name, template in templates:
        own = license_scan.bigrams(license_scan.words(template))
        marks, n, mine = license_scan.required(own), sum(own.values()), []
        for i in range(len(pairs)):
            best = None
            for j in range(i, len(pairs)):
                inside = Counter(pairs[i : j + 1])
                both = sum((inside & own).values())
                score = 2 * both / (n + j + 1 - i)
                if pairs[i] in own and pairs[j] in own and marks <= set(inside) and score >= t - 1e-12 and (best is None or score > best[1] + 1e-12):
                    best = (both, score, i, j)
            if best:
                mine.append(best)
        found += [(*x, name) for x in plain_disjoint(sorted(mine, key=lambda x: (-x[1], x[2])))]
    chosen = plain_disjoint(sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])))
    return [(x[4], round(x[1], 9)) for x in sorted(chosen, key=lambda x: x[2])]


def plain_disjoint(found):
    out = []
    for x in found:
        if all(x[3] + 1 < y[2] or y[3] + 1 < x[2] for y in out):
            out.append(x)
    return out


def test_scan_with_all_templates_against_brute_force():
    r = np.random.default_rng(4)
    short = [x for x in license_scan.TEMPLATES if len(license_scan.words(x[1])) <= 45]
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.Settings())
    for _ in range(12):
        parts = []
        for _ in range(2):
            w = short[r.integers(len(short))][1].split()
            for _ in range(r.integers(0, 3)):
                w.insert(r.integers(len(w) + 1), str(r.choice(["the", "license", "zebra", "of"])))
            parts += [" ".join(w), " ".join(r.choice(["of", "the", "license", "software", "stone"], 4))]
        text = " ".join(parts)
        assert [(n, round(s, 9)) for _, n, s in scanner.scan(text)] == plain_scan(text, license_scan.TEMPLATES, 0.8)


def test_every_template_names_its_licence():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.Settings())
    for name, text in license_scan.TEMPLATES:
        assert [n for _, n, _ in scanner.scan(f"Some words before it. {text} And some after it.")] == [name], text


def test_versions_and_relatives():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.Settings())
    names = lambda t: [n for _, n, _ in scanner.scan(t)]
    gnu = "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {family}General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version."
    for what, a, family, b, v, name in (("program", ";", "", ";", "2", "GPL-2.0"), ("program", ":", "", ",", "3", "GPL-3.0"), ("library", ";", "Lesser ", ";", "2.1", "LGPL-2.1"), ("library", ":", "Lesser ", ",", "3", "LGPL-3.0"), ("program", ":", "Affero ", ",", "3", "AGPL-3.0"), ("package", ";", "", ";", "2", "GPL-2.0")):
        assert names(gnu.format(what=what, a=a, family=family, b=b, v=v)) == [name]
    assert names(gnu.format(what="program", a=";", family="", b=";", v="1")) == []  # a version that no template states
    assert names("This work is licensed under the GNU General Public License, version 9.") == []


def test_licences_within_lines():
    """Notices amid prose, whole texts on one line and behind other words, each with its own name."""
    s = license_scan.Scanner(license_scan.TEMPLATES, license_scan.Settings())
    names = lambda text: [h[1] for h in s.scan(text)]
    assert names("This project is released under the MIT License.") == ["MIT"]
    assert names("We hope you like it. Licensed under the Apache License, Version 2.0. And more of it follows") == ["Apache-2.0"]
    assert names("we say: licensed under CC BY-NC 4.0 and then, licensed under CC BY 4.0 too") == ["CC-BY-NC-4.0", "CC-BY-4.0"]
    for name, text in license_scan.TEMPLATES[23:]:
        assert names(f"Copyright (c) 2020 A. Person {text} Thanks for reading all of this.") == [name]
        assert [h[:2] for h in s.scan("a\nb\n" + text.replace(". ", ".\n\n"))] == [(2, name)]


def test_windows_are_the_best():
    """One template on random texts: a window is found where one reaches the threshold, with the best score of all."""
    r = np.random.default_rng(5)
    for _ in range(300):
        draw = lambda n: " ".join(r.choice(list("abc"), n))
        template, text = draw(int(r.integers(3, 7))), draw(int(r.integers(2, 16)))
        w, b = text.split(), license_scan.bigrams(template.split())
        want = max((license_scan.dice(b, license_scan.bigrams(w[i:j])) for i in range(len(w)) for j in range(i + 2, len(w) + 1)), default=0)
        got = max((h[2] for h in license_scan.Scanner([("x", template)], license_scan.Settings()).scan(text)), default=0)
        assert abs(got - (want if want >= 0.8 - 1e-12 else 0)) < 1e-9


# 10 ---------------------------------------------------------------------------


def check_pieces(rows, expected):
    """expected: ids of each document, as a list of (id, ids)."""
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    if len({i for i, _ in expected}) == len(expected):
        for key, ids in expected:
            at = 0
            for r in sorted(by[key], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
    padded = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0
    assert sum(r.length for r in rows) == sum(len(i) for _, i in expected)


def test_packing(spark, docs, odd, none):
    encode = library(WORD)
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        check_pieces(packing.pack_documents(df, WORD).collect(), [(r.doc_id, [*encode(r.text), 1]) for r in df.collect()])
    check_pieces(packing.pack_documents(odd, WORD).collect(), [(r.doc_id, [*encode(r.text), 1]) for r in odd.collect()])
    assert packing.pack_documents(none, WORD).count() == 0


def test_small_shards(spark, docs):
    encode = library(WORD)
    rows = packing.pack_documents(docs, WORD, packing.Settings(shard_docs=7), with_ids=True).collect()
    check_pieces(rows, [(r.doc_id, [*encode(r.text), 1]) for r in docs.collect()])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("frequent, block", [(1024, 256), (20, 3), (0, 1)])
def test_neighbours_are_bm25(frequent, block):
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 300, rng.integers(5, 80)) for _ in range(40)]
    df = np.zeros(300)
    for x in ids:
        df[np.unique(x)] += 1
    idf, mean, s = np.log1p((40 - df + 0.5) / (df + 0.5)), np.mean([len(x) for x in ids]), packing.Settings(frequent=frequent, block=block)
    shard = packing.Shard(ids, idf, mean, s)

    def weight(d, t):
        tf = (ids[d] == t).sum()
        return idf[t] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(ids[d]) / mean))

    want = {d: sum(weight(d, t) for t in set(ids[3].tolist())) for d in range(40) if d != 3}
    got = shard.neighbours(3).tolist()
    assert set(got) == {d for d, w in want.items() if w > 0}
    assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:]))
