import difflib
import random
import re
import statistics
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexgauge.functions import chrf, rules, stats, values


def one(spark, rows, column, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {column} string").select("i", expr.alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


def test_numbers_and_flags(spark):
    cells = ["", " 1.5 ", "nan", "inf", "-.5", "1e3", "1d", "1_000", "x", None, "200.0", "yes", "NG", "maybe", "　ok　"]
    assert one(spark, cells, "c", values.as_float("c")) == [None, 1.5, None, None, -0.5, 1000.0, None, 1000.0, None, None, 200.0, None, None, None, None]
    assert one(spark, cells, "c", values.to_int("c"))[:6] == [None, 1, None, None, 0, 1000]
    assert one(spark, cells, "c", values.as_bool("c"))[-4:] == [True, False, None, True]


def test_trim_takes_all_white_space(spark):
    rows = ["\x1ca\x1f", "　b ", "\n c\t", "", None, " \x85 d"]
    assert one(spark, rows, "c", values.trimmed("c")) == ["a", "b", "c", "", "", "d"]


def py_normalize(t):
    t = unicodedata.normalize("NFKC", t or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    return re.sub(r"[ \t\f\v]+", " ", t)


def test_normalize(spark):
    r = random.Random(3)
    pool = "aB Ａ１％\t\r\n\x0b\x0c　①ﾊﾟé\x1c \x85。"
    rows = ["".join(r.choice(pool) for _ in range(r.randint(0, 20))) for _ in range(400)] + [None]
    assert one(spark, rows, "c", rules.normalize_text("c")) == [py_normalize(t) for t in rows]


def py_count(text, token):
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?%?", token):
        return len(re.findall(rf"(?<![0-9.]){re.escape(token)}(?![0-9.])", text))
    return text.count(token)


def test_protected_tokens(spark):
    r = random.Random(5)
    data = []
    for _ in range(500):
        text = "".join(r.choice("0123.% aE") for _ in range(r.randint(0, 25)))
        tokens = [r.choice(["1", "10", "2.3", "10%", "E", "aE", "0", "3%"]) for _ in range(r.randint(0, 5))]
        data.append((text, ";".join(tokens)))
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, t string, k string")
    out = df.select("i", rules.recall(F.col("t"), rules.split_semicolon(F.col("k"))).alias("r")).orderBy("i").collect()
    for (text, packed), row in zip(data, out):
        want = Counter(p.strip() for p in packed.split(";") if p.strip())
        matched = sum(min(py_count(text, k), c) for k, c in want.items())
        missing = Counter({k: c - min(py_count(text, k), c) for k, c in want.items()})
        assert (row.r.expected, row.r.matched) == (sum(want.values()), matched)
        assert Counter(x for x in row.r.missing.split(";") if x) == +missing


def test_full_width_semicolon_does_not_cut(spark):
    assert one(spark, ["Ａ；B;c"], "c", rules.tokens_of("c")) == [["A;B", "c"]]


def test_terms(spark):
    got = one(spark, ["a=b;c=;=d;e=f=g;none"], "c", rules.terms_of(rules.tokens_of("c")))
    assert [(t.source, t.target) for t in got[0]] == [("a", "b"), ("", "d"), ("e", "f=g")]


@pytest.mark.parametrize("text,found", [("翻訳: x", True), ("a\ntranslation : b", True), ("my translation: b", False), ("HERE IS THE TRANSLATION :", True), ("以下が翻訳です", True)])
def test_extra_text(spark, text, found):
    assert bool(one(spark, [text], "c", rules.extra_text(F.col("c")))[0]) is found


@pytest.mark.parametrize("text,found", [("```", True), ("x\n## y", True), ("#y", False), ("- y", True), ("1. y", True), ("> y", True), ("**b**", True), ("__b__", True), ("*b*", False), ("a\u2028- b", False)])
def test_markdown(spark, text, found):
    assert one(spark, [text], "c", rules.has_markdown(F.col("c"))) == [found]


def test_quotes(spark):
    assert one(spark, ['"a"', '"', "「a」", "「a", "'a'"], "c", rules.is_quoted(F.col("c"))) == [True, False, True, False, True]


def test_longest_common():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in "ab")
        assert rules.longest_common(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size


def raw(spark, **cells):
    row = {"model_name": "m", "run_id": "1", "id": "a", "source_en": "Attack 10%", "reference_ja": "攻撃 10%", "translation_ja": "攻撃 10%", "protected_tokens": "10%", "required_terms": "Attack=攻撃", "request_success": "true", "http_status": "200", "finish_reason": "stop", "error": "", "error_type": "", "input_variant": "standard"} | cells
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


@pytest.mark.parametrize(
    "cells,status,failures,warnings",
    [
        ({}, "PASS", "", ""),
        ({"translation_ja": "null"}, "FAIL", "request_success=false;empty_output;protected_tokens_missing", "required_terms_missing;english_residue_detected"),
        ({"translation_ja": "打撃 10%"}, "WARN", "", "required_terms_missing"),
        ({"translation_ja": "打撃 10%", "input_variant": "terminology"}, "FAIL", "required_terms_missing", ""),
        ({"finish_reason": "length"}, "FAIL", "request_success=false", ""),
        ({"http_status": ""}, "PASS", "", ""),
        ({"translation_ja": "「攻撃 10%」"}, "WARN", "", "unnecessary_quotes"),
        ({"translation_ja": "攻撃 110%"}, "FAIL", "protected_tokens_missing", ""),
    ],
)
def test_rules(spark, cells, status, failures, warnings):
    row = rules.apply_rules(raw(spark, **cells)).first()
    assert (row.rule_check_status, row.failure_reasons, row.warning_reasons) == (status, failures, warnings)


def test_request_reasons(spark):
    row = rules.apply_rules(raw(spark, request_success="false", http_status="500", error="x", error_type="timeout", finish_reason="LENGTH")).first()
    assert row.request_error_type == "request_success=false;http_status=500;error;timeout;finish_reason=length"
    assert row.request_success is False


def test_rule_columns_are_complete(spark):
    out = rules.apply_rules(raw(spark).drop("http_status", "error", "error_type", "input_variant"))
    assert set(rules.RULE_COLUMNS) <= set(out.columns)


def test_config_overlay():
    c = rules.RuleConfig.from_json('{"allowed_english_terms": ["Z"], "unknown": 1}', strict_terms=True)
    assert c.allowed_english_terms == ["Z"] and c.strict_terms and c.english_word_warning_count == 4


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 37, 59, 400])
def test_exclusive_quantile(spark, n):
    x = [float(i * i % 101) for i in range(n)]
    got = spark.createDataFrame([(v,) for v in x], "x double").agg(stats.exclusive_p95(F.col("x"))).first()[0]
    assert got == pytest.approx(statistics.quantiles(x, n=20)[18] if n >= 20 else max(x))


def py_chrf(pairs):
    sums = []
    for n in range(1, 7):
        m = h = r = 0
        for a, b in pairs:
            A, B = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in ("".join(a.split()), "".join(b.split())))
            m, h, r = m + sum((A & B).values()), h + sum(A.values()), r + sum(B.values())
        sums.append((m, h, r))

    def words(t):
        out = []
        for w in t.split():
            p = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
            if len(w) > 1 and w[-1] in p:
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in p:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    for n in (1, 2):
        m = h = r = 0
        for a, b in pairs:
            A, B = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (words(a), words(b)))
            m, h, r = m + sum((A & B).values()), h + sum(A.values()), r + sum(B.values())
        sums.append((m, h, r))
    use = [(m / h, m / r) for m, h, r in sums if h and r]
    p, q = (sum(x[i] for x in use) / len(use) for i in (0, 1))
    return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0


def test_chrf(spark):
    pairs = [("the cat sat.", "the cat sat on it."), ("猫が 座る", "猫は座った"), ("", "x"), ("(a b", "a b")]
    df = spark.createDataFrame([("g", a, b) for a, b in pairs], "g string, hypothesis string, reference string")
    assert chrf.corpus_chrf(df, ["g"]).first().chrf == pytest.approx(py_chrf(pairs))


def test_chrf_holds_little_of_a_batch():
    """What is held is what is counted at once, however many segments and words a batch has."""
    import tracemalloc

    import pyarrow as pa

    words = [[f"w{i * j % 977}" for j in range(150)] for i in range(4000)]
    whole = pa.array(["".join(w) for w in words]), pa.array(words)
    tracemalloc.start()
    try:
        out = chrf.overlap(*whole, *whole)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == 4000 and peak < 64 << 20
    for i in (0, 1, 3999):
        row = out[i].as_py()
        assert len(row) == 24 and row[0] == row[1] == row[2] == len("".join(words[i])) and row[-3] == row[-2] == row[-1] == 149
