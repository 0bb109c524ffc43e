"""Order statistics, trade-off sets, divergent items, invalid runs and permutations against plain computations."""

import math
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgauge.operators import divergence, inputs, invalid_runs, ranks, sampling, skyline


def values(kind, n, r):
    if kind == "ties":
        return [float(r.choice([0, 1, 2])) for _ in range(n)]
    if kind == "wide":
        return [math.exp(r.uniform(-300, 300)) * r.choice([-1, 1]) for _ in range(n)] + [1e308, -1e308, 5e-324]
    return [r.random() for _ in range(n)]


@pytest.mark.parametrize("kind", ["ties", "wide"])
def test_percentiles_have_the_digits_of_the_built_in(spark, kind):
    r = random.Random(kind)
    rows = [(g, v) for g, n in (("a", 700), ("b", 40), (None, 300), ("c", 1)) for v in values(kind, n, r)] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.p5, x.p50, x.p99) for x in ranks.percentiles(df, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p99": 0.99}, keep=30).collect()}
    plain = df.where("not isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.05, 0.5, 0.99)])).alias("p")).where("p is not null")
    assert got == {x.g: tuple(x.p) for x in plain.collect()}


def test_order_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    asked = spark.createDataFrame([("a", 0), ("a", 9)], "g string, rank long")
    assert ranks.order_statistics(none, ["g"], "v", asked).count() == 0
    one = spark.createDataFrame([("a", 3.0)], "g string, v double")
    assert [tuple(x) for x in ranks.order_statistics(one, ["g"], "v", asked).collect()] == [("a", 0, 3.0)]


@pytest.mark.parametrize(("v", "share", "kept"), [([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 0.2, [9, 10]), ([1, 5, 5, 5], 0.5, []), ([1, 2, 5, 5], 0.5, [5, 5]), ([3, 3], 1.0, [3, 3]), ([], 0.5, [])])
def test_top_share_never_passes_its_share(spark, v, share, kept):
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert sorted(x.v for x in ranks.top_share(df, "v", share, keep=2).collect()) == kept


def plain_skyline(rows):
    better = [tuple(-math.inf if x is None or x != x else x * s for x, s in zip(r[1:], (1, 1, -1))) for r in rows]
    return {r[0] for r, b in zip(rows, better) if not any(all(x >= y for x, y in zip(o, b)) and o != b for o in better)}


@pytest.mark.parametrize("block", [3, 20_000])
def test_skyline_against_all_pairs(spark, block):
    r = random.Random(block)
    cell = lambda: r.choice([None, float("nan"), 0.0, -0.0, 1.0, 2.0, r.random() * 3])
    rows = [(i, cell(), cell(), cell()) for i in range(150)] + [(i + 200, math.cos(i / 50), math.sin(i / 50), 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    assert {x.id for x in skyline.skyline(df, ["a", "b"], ["c"], block).collect()} == plain_skyline(rows)


def test_skyline_edge_cases(spark):
    none = spark.createDataFrame([], "id long, a double")
    assert skyline.skyline(none, ["a"]).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "id long, a double")
    assert skyline.skyline(nulls, [], ["a"]).count() == 2
    with pytest.raises(ValueError):
        skyline.skyline(none)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_divergence(spark):
    texts = {("i", "m1"): "日本語", ("i", "m2"): "日本", ("i", "m3"): "", ("k", "m1"): "same", ("k", "m2"): "same", ("alone", "m1"): "x", ("e", "m1"): "", ("e", "m2"): None}
    rows = [(m, "1", i, "standard", t) for (i, m), t in texts.items()] + [("m1", "2", "k", "standard", "other run"), ("m1", "1", "k", "standard", "tame")]
    df = spark.createDataFrame(rows, "model_name string, run_id string, id string, input_variant string, translation_ja string")
    got = {x.id: x for x in divergence.item_divergence(df).collect()}
    assert set(got) == {"i", "k", "e"}
    apart = [edits(a, b) / max(len(a), len(b)) for a, b in (("日本語", "日本"), ("日本語", ""), ("日本", ""))]
    assert got["i"].divergence == pytest.approx(statistics.mean(apart), abs=1e-9) and got["i"].widest == 1.0 and got["i"].model_count == 3
    assert (got["k"].divergence, got["e"].divergence) == (0.0, 0.0)
    raw = {x.id: x for x in divergence.item_divergence(df, unit="bytes").collect()}
    assert raw["i"].divergence == pytest.approx((3 / 9 + 1 + 1) / 3, abs=1e-9)
    assert [x.id for x in divergence.strongly_divergent(df, 0.5).collect()] == ["i"]


def test_invalid_runs(spark):
    columns = "model_name string, run_id string, id string, input_variant string, request_success string, temperature string, system_prompt_hash string"
    rows = [(m, run, f"i{i}", "standard", "false" if (m, run) == ("a", "2") and i < 9 else "true", "0.5" if (m, run, i) == ("b", "1", 3) else "0", "q" if (m, run) == ("b", "2") else "p") for m in "ab" for run in "123" for i in range(20)]
    rows = [x for x in rows if x[:3] != ("a", "1", "i7")] + [rows[0], rows[0]]
    got = {tuple(x)[:3] + (x.amount, x.detail) for x in invalid_runs.invalid_runs(spark.createDataFrame(rows, columns)).collect()}
    assert got == {("missing_items", "a", "1", 1, ""), ("duplicate_keys", "a", "1", 2, ""), ("failure_outlier", "a", "2", 9, ""), ("settings_differ", "b", "1", 1, "temperature"), ("prompt_differs", "b", "2", 20, "system_prompt_hash")}
    assert invalid_runs.invalid_runs(spark.createDataFrame([], columns)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 17, 1000])
def test_permuted_is_a_permutation(spark, n):
    df = spark.range(n).select((F.col("id") * 7).alias("line_no"))
    first, again, other = ([x.execution_index for x in inputs.permuted(df, seed).orderBy("line_no").collect()] for seed in (1, 1, 2))
    assert sorted(first) == sorted(other) == list(range(1, n + 1)) and first == again
    if n == 1000:
        assert first != other and abs(np.corrcoef(first, range(n))[0, 1]) < 0.15
        assert sum(a == b for a, b in zip(first, other)) < 20


def test_weights_are_poisson():
    bounds = [int(b, 16) / 2**32 for b in sampling.weight_bounds()]
    assert bounds[0] == pytest.approx(math.exp(-1)) and sum(1 - b for b in bounds) == pytest.approx(1, abs=1e-6)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_of_near_and_far_texts(spark):
    """Every band and the whole table."""
    r = random.Random(4)
    rows = []
    for n in (0, 1, 7, 60, 300, 600):
        a = "".join(r.choice("abcdé日") for _ in range(n))
        for edits in (0, 1, 30, 33, 50, 80, 400):
            b = list(a)
            for _ in range(edits):
                b.insert(r.randint(0, len(b)), r.choice("xyz")) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
            rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    for x in df.select("a", "b", divergence.distance(df.a, df.b).alias("d")).collect():
        assert x.d == pytest.approx(plain_edits(x.a, x.b) / max(len(x.a), len(x.b), 1))


def test_divergence_of_long_near_texts(spark):
    """Models of one text meet others once, and near texts in a band: 66 whole tables of 400 million cells take minutes."""
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(20_000))
    rows = [(f"m{k}", "1", "i", "v", text if k < 10 else text[:50] + "x" + text[50 + k :]) for k in range(12)]
    df = spark.createDataFrame(rows, "model_name string, run_id string, id string, input_variant string, translation_ja string")
    began = time.time()
    got = divergence.item_divergence(df).first()
    assert time.time() - began < 15
    far = [k / 20_000 for k in (10, 11)]  # an inserted character and k deleted ones, at one place: k edits
    between = 1 / len(rows[10][4])
    assert got.model_count == 12 and got.widest == pytest.approx(far[1])
    assert got.divergence == pytest.approx((10 * sum(far) + between) / 66, abs=1e-9)


def test_ranges_go_to_the_rows(spark):
    """Rows of a few groups are not dealt out by group, whatever Spark knows of sizes."""
    df = spark.range(5000).selectExpr("cast(id % 2 as string) AS g", "cast(id * 7919 % 5003 as double) AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("0", 7), ("1", 9)], "g string, rank long")
        out = ranks.order_statistics(df, ["g"], "v", asked, keep=100)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
        values = {g: sorted(float(i * 7919 % 5003) for i in range(5000) if i % 2 == g) for g in (0, 1)}
        assert {x.g: x.x for x in out.collect()} == {"0": values[0][7], "1": values[1][9]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
