import json
import re

import pytest
from pyspark.sql import functions as F

from lexgauge.cli import main
from lexgauge.operators import inputs, quality, responses, sampling, summaries
from lexgauge.sources import completions, result_tree, settings
from lexgauge.sinks.reports import cell, corpus_lines, write_csv

KEY = "model_name,run_id,id,input_variant"


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8-sig")
    return path


@pytest.fixture
def tree(tmp_path):
    for m in ("alpha", "beta"):
        extra = "" if m == "alpha" else f"{m},1,i9,standard,true,50,x\n"
        put(tmp_path, f"{m}/standard/run_001_raw_results.csv", f"{KEY},request_success,total_latency_ms,category\n{m},1,i1,standard,true,100,ui\n{m},1,i2,standard,true,-3,ui\n{m},1,i1,standard,true,999,dup\n{m},1,,standard,true,1,x\n{extra}")
        put(tmp_path, f"{m}/standard/run_001_rule_evaluation.csv", f"{KEY},rule_check_status,request_success,translation_ja\n{m},1,i1,standard,PASS,false,\"a\n\"\"b\"\"\"\n{m},1,i3,standard,WARN,true,c\n")
        put(tmp_path, f"{m}/x_comet_scores.csv", f"{KEY},score,category\n{m},1,i1,standard,0.5,\n{m},1,i2,standard,7,kept\n")
    put(tmp_path, "broken/run_raw_results.csv", f"{KEY}\n")
    return tmp_path


def test_tree(spark, tree):
    t = result_tree.load_tree(spark, str(tree))
    assert t.bundles == ["alpha", "beta"]
    rows = {(r.bundle, r.id): r for r in t.facts.collect()}
    assert set(rows) == {("alpha", "i1"), ("alpha", "i2"), ("alpha", "i3"), ("beta", "i1"), ("beta", "i2"), ("beta", "i3"), ("beta", "i9")}
    a = rows["alpha", "i1"]
    assert (a.request_success, a.total_latency_ms, a.category, a.translation_ja, a.comet_score) == ("false", "100", "", 'a\n"b"', "0.5")
    assert rows["alpha", "i2"].category == "kept"
    issues = [r.issue for r in t.findings.collect() if r.model_name in ("alpha", "broken")]
    for want in ("raw: duplicate composite key", "raw: missing id", "raw row has no matching rule_evaluation row", "rule_evaluation row has no matching raw row", "COMET score outside expected range", "negative latency", "missing rule_evaluation.csv"):
        assert want in issues
    assert "extra 1 items compared with alpha" in [r.issue for r in t.findings.collect()]
    spots = [r.key for r in t.findings.collect() if r.issue == "raw: missing id"]
    assert spots == ["line 5", "line 5"]


def test_missing_columns_skip_the_file(spark, tmp_path):
    put(tmp_path, "m/a_raw_results.csv", f"{KEY},request_success\nm,1,i1,standard,true\n")
    put(tmp_path, "m/b_raw_results.csv", f"{KEY},request_success,total_latency_ms\nm,1,i2,standard,true,5\n")
    put(tmp_path, "m/a_rule_evaluation.csv", f"{KEY},rule_check_status\nm,1,i2,standard,PASS\n")
    t = result_tree.load_tree(spark, str(tmp_path))
    assert [r.id for r in t.facts.collect()] == ["i2"]
    assert any("missing columns: total_latency_ms" in r.issue for r in t.findings.collect())


def test_smoke_runs(spark, tmp_path):
    """Smoke runs lie in a folder within a bundle, or are a bundle; a name that only holds the word is none."""
    for d, i in (("smoke-lab/smoke", "s"), ("smoke-lab/standard", "k"), ("smoke", "b")):
        put(tmp_path, f"{d}/run_001_raw_results.csv", f"{KEY},request_success,total_latency_ms\nm,1,{i},standard,true,5\n")
        put(tmp_path, f"{d}/run_001_rule_evaluation.csv", f"{KEY},rule_check_status\nm,1,{i},standard,PASS\n")
    ids = lambda **a: sorted(r.id for r in result_tree.load_tree(spark, str(tmp_path), **a).facts.collect())
    assert ids() == ["b", "k", "s"] and ids(exclude_smoke=True) == ["k"]
    assert result_tree.is_smoke("file:/a/smoke/b/smoke/x.csv", "/a/smoke/b") and not result_tree.is_smoke("file:///a/smoke/b/x.csv", "file:/a/smoke/b/")


def test_aggregate_command(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    call = ["aggregate", "--results-dir", str(tree), "--output-dir", str(out)]
    assert main(call, spark) == 0
    assert len(list(out.glob("*.csv"))) == 10 and json.loads((out / "summary.json").read_text("utf-8"))["bundles"] == ["alpha", "beta"]
    assert (out / "model_summary.csv").read_bytes().startswith(b"\xef\xbb\xbfmodel_name,")
    assert main(call, spark) == 5
    assert main([*call, "--overwrite"], spark) == 0


def test_rules_command(spark, tmp_path):
    names = "model_name,run_id,id,source_en,reference_ja,translation_ja,protected_tokens,required_terms,request_success"
    src = put(tmp_path, "in.csv", f"{names}\nm,1,a,Go,行く,行く,,,true\nm,1,b,Go,行く,,,,true\n")
    assert main(["rules", "--input", str(src), "--output", str(tmp_path / "o.csv")], spark) == 0
    lines = (tmp_path / "o.csv").read_text("utf-8-sig").splitlines()
    assert len(lines) == 3 and ",PASS," in lines[1] and ",FAIL," in lines[2]
    assert main(["rules", "--input", str(src), "--output", (tmp_path / "tasks.csv").as_uri()], spark) == 0
    assert (tmp_path / "tasks.csv").read_bytes() == (tmp_path / "o.csv").read_bytes()
    bad = put(tmp_path, "bad.csv", "id\n1\n")
    assert main(["rules", "--input", str(bad), "--output", str(tmp_path / "p.csv")], spark) == 3


def test_cells():
    assert [cell(x) for x in (None, float("nan"), float("inf"), 0.1234565, True, 3, "x")] == ["", "", "", f"{0.1234565:.6f}", "true", "3", "x"]


def test_settings():
    bounds, low = settings.thresholds("qualification:\n  minimum_success_rate: 0.9 # c\nfailed_case:\n  minimum_comet_score: 0.2\nmaximum_x: 1\n")
    assert bounds.minimum_success_rate == 0.9 and bounds.maximum_critical_error_rate == 0.01 and low == 0.2
    assert settings.parse("a:\n k: 'v'\nb: 2\n") == {"a": {"k": "v", "b": 2}}
    assert settings.parse('{"qualification": {"x": 1}, "other": {}}') == {"qualification": {"x": 1}}
    with pytest.raises(ValueError):
        settings.parse("[1]")


def facts(spark, rows):
    names = "model_name run_id id input_variant request_success total_latency_ms translation_ja rule_check_status protected_tokens_pass human_usability_pass comet_score".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_missing_metric_outranks_failure(spark):
    f = facts(spark, [("m", "1", "a", "standard", "false", "5", "x", "FAIL", "", "", "")])
    row = summaries.model_summary(f).first()
    assert (row.qualification_status, row.qualification_failure_reasons) == ("INSUFFICIENT_DATA", "protected_token_pass_rate")


def test_failure_text(spark):
    f = facts(spark, [("m", "1", "a", "standard", "true", "5", "x", "FAIL", "true", "", ""), ("m", "1", "b", "standard", "true", "7", "x", "PASS", "true", "", "")])
    row = summaries.model_summary(f).first()
    assert row.qualification_failure_reasons == "critical_error_rate=0.500000 > maximum_critical_error_rate=0.010000"
    assert (row.latency_p50_ms, row.latency_p95_ms) == (6.0, pytest.approx(6.9))


def test_zero_usability_ranks_like_none(spark):
    df = spark.createDataFrame([("a", "PASS", 0.0, 0.0, 0.5, 1.0), ("b", "PASS", 0.0, None, 0.6, 1.0)], "model_name string, qualification_status string, critical_error_rate double, human_usability_pass_rate double, comet_mean double, latency_p95_ms double")
    assert [r.model_name for r in summaries.sort_final(df).collect()] == ["b", "a"]


def test_empty_facts(spark):
    f = facts(spark, [])
    assert summaries.model_summary(f).count() == summaries.stability_summary(f).count() == summaries.noise_summary(f).count() == 0


ITEM = "id,category,subcategory,difficulty,source_en,reference_ja,protected_tokens,required_terms,evaluation_focus"


def test_items(spark, tmp_path):
    src = put(tmp_path, "items.csv", f"{ITEM}\na,ui,x,easy,Hi,はい,,,\na,ui,x,odd,,はい,,,\n,ui,x,hard,Hi,はい\n")
    items = result_tree.load_items(spark, str(src))
    got = [r.errors for r in inputs.violations(items).orderBy("line_no").collect()]
    assert got == [[], ["duplicate id", "source_en is empty", "invalid difficulty"], ["id is empty"]]
    assert inputs.valid_items(items, skip_invalid=True).count() == 1
    with pytest.raises(inputs.ValidationError):
        inputs.valid_items(items)
    assert sorted(r.execution_index for r in inputs.shuffled(items, 1).collect()) == [1, 2, 3]


def test_unknown_variant(spark):
    df = spark.createDataFrame([("x", "y", "z")], "source_en string, context_ja string, required_terms string")
    with pytest.raises(Exception, match="unsupported input variant"):
        df.select(inputs.input_text("other")).collect()


def test_first_wins_with_hot_key(spark):
    rows = spark.range(200).selectExpr("'m' AS model_name", "'1' AS run_id", "'k' AS id", "'standard' AS input_variant", "'f' AS file", "id + 1 AS record_no")
    kept, bad = quality.first_wins(quality.keyed(rows), "raw", ["file", "record_no"])
    assert kept.first().record_no == 1 and bad.count() == 199


def test_a_hot_key_is_split(spark):
    """A third of the rows on one key: the join with the firsts is one that AQE splits."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        name = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
        rows = spark.range(0, 60_000, 1, 8).select(F.lit("m").alias("model_name"), F.lit("1").alias("run_id"), name.alias("key"), F.lit("standard").alias("input_variant"), F.lit("f").alias("file"), F.col("id").alias("record_no"), F.sha2(F.col("id").cast("string"), 512).alias("cells"))
        kept, again = quality.first_wins(quality.keyed(rows.withColumnRenamed("key", "id")), "raw", ["file", "record_no"])
        checked = inputs.violations(rows.select(F.col("key").alias("id"), F.col("record_no").alias("line_no"), *[F.lit("easy").alias(c) for c in inputs.REQUIRED[1:]], "cells"))
        kept, again, checked = kept.select("cells"), again.select("key"), checked.where(F.size("errors") == 0).select("cells")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert (len(kept.collect()), len(again.collect()), len(checked.collect())) == (40_001, 19_999, 40_001)
        # firsts are found by key and place together, which no two rows share; the others by key alone
        assert re.search(r"hashpartitioning\(cast\(struct\(file, f, record_no", plan(kept)) and "skew=true" in plan(again) and "skew=true" in plan(checked)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_usage_falls_back_only_where_absent(spark):
    body = '{"choices":[{"message":{"content":"x"}}],"usage":{"prompt_tokens":null},"timings":{"prompt_n":7,"predicted_n":8}}'
    r = responses.parse_responses(spark.createDataFrame([("a", body)], "id string, raw_response string")).first()
    assert (r.prompt_tokens, r.completion_tokens, r.error_type) == (None, 8, "")


def test_completions_retry_and_rows(spark):
    def send(server, payload):
        body = json.loads(payload)
        send.calls = getattr(send, "calls", 0) + 1
        return completions.Reply(False, 503, error_type="http") if body["n"] == 2 else completions.Reply(True, 200, "{}")

    server = completions.Server("http://none", retries=2, wait=0)
    assert completions.with_retries(server, '{"n": 2}', send)[1] == 3
    assert completions.with_retries(server, '{"n": 1}', send)[1] == 1
    df = spark.createDataFrame([("a", '{"n": 1}'), ("b", '{"n": 2}')], "id string, payload string")
    got = {r.id: r for r in completions.complete(df, server, send).collect()}
    assert got["a"].ok and not got["b"].ok and got["b"].retry_count == 2
    assert completions.post(completions.Server("http://127.0.0.1:9", timeout=1), "{}").error_type == "connection"


def test_bootstrap_is_repeatable(spark):
    df = spark.range(50).selectExpr("'m' AS model_name", "cast(id AS string) AS id", "cast(id % 10 AS double) AS x")
    a, b = (sampling.bootstrap(df, ["model_name"], "x", 100).first() for _ in "ab")
    assert a == b and a.low < a["mean"] < a.high


def test_alignment_and_lines(spark):
    df = spark.createDataFrame([("b", "x\ny"), ("a", " z ")], "id string, t string")
    lines = corpus_lines(df, "t")
    assert [(r.line_no, r.id, r.line) for r in lines.orderBy("line_no").collect()] == [(1, "a", "z"), (2, "b", "x y")]
    r = quality.alignment(lines.withColumnRenamed("line", "text"), lines.where("id = 'a'").withColumnRenamed("line", "text")).first()
    assert (r.only_left, r.only_right, r.moved, r.blank) == (1, 0, 0, 0)


def test_stream_evaluates_each_file_once(spark, tmp_path):
    from lexgauge.streaming.incremental import evaluate_stream, windowed_rates

    src = spark.createDataFrame([("m", "a", "Go", "行く", "行く", "", "", "true")], "model_name string, id string, source_en string, reference_ja string, translation_ja string, protected_tokens string, required_terms string, request_success string")
    where = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    src.write.parquet(where[0])
    for _ in range(2):
        evaluate_stream(spark, where[0], src.schema, where[1], where[2]).awaitTermination()
    assert spark.read.parquet(where[1]).count() == 1
    timed = src.withColumn("at", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert windowed_rates(timed, "at").first().success_rate == 1.0


def test_write_csv_columns(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, None)], "a int, b string"), tmp_path / "x.csv", ["b", "c", "a"])
    assert (tmp_path / "x.csv").read_text("utf-8-sig").split() == ["b,c,a", ",,1"]
