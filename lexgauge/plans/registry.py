"""Named queries over the derived views and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.functions import chrf, rules
from lexgauge.functions.values import KEY, as_bool, as_float, key_text, to_int, trimmed
from lexgauge.operators import inputs, merge, quality, responses, sampling, summaries
from lexgauge.operators.facts import typed

from .views import cte, view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to ``digits`` places, counts as longs, for comparison between engines."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "facts")


OK = "request_success = 'true'"
EMPTY = "trim(translation_ja) = ''"
CRIT = f"(NOT ({OK}) OR {EMPTY} OR rule_check_status = 'FAIL')"
TRI = "CASE {c} WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END"
PROT, REQ, USE = (TRI.format(c=c) for c in ("protected_tokens_pass", "required_terms_pass", "human_usability_pass"))
LAT = f"CASE WHEN {OK} THEN total_latency_ms END"
GEN = f"CASE WHEN {OK} THEN generation_tokens_per_second END"


def r4(expr: str, name: str) -> str:
    return f"round(cast({expr} as double), 4) + 0.0::double AS {name}"  # turns a negative zero into zero


SPEED = f"""
  count(*) AS request_count, count(*) FILTER ({OK}) AS success_count, count(*) FILTER (NOT ({OK})) AS failure_count,
  {r4(f"avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END)", "success_rate")},
  count(*) FILTER (error_type LIKE '%timeout%') AS timeout_count, count(*) FILTER ({EMPTY}) AS empty_output_count,
  {r4(f"avg({LAT})", "latency_mean_ms")}, {r4(f"quantile_cont({LAT}, 0.5)", "latency_p50_ms")}, {r4(f"quantile_cont({LAT}, 0.95)", "latency_p95_ms")},
  {r4(f"min({LAT})", "latency_min_ms")}, {r4(f"max({LAT})", "latency_max_ms")}, {r4(f"stddev_samp({LAT})", "latency_stddev_ms")},
  {r4(f"avg(CASE WHEN {OK} THEN prompt_tokens_per_second END)", "prompt_tps_mean")}, {r4(f"avg({GEN})", "generation_tps_mean")},
  {r4(f"quantile_cont({GEN}, 0.5)", "generation_tps_p50")}, {r4(f"quantile_cont({GEN}, 0.95)", "generation_tps_p95")}"""
SPEED_COLUMNS = ["model_name", "request_count", "success_count", "failure_count", "success_rate", "timeout_count", "empty_output_count", "latency_mean_ms", "latency_p50_ms", "latency_p95_ms", "latency_min_ms", "latency_max_ms", "latency_stddev_ms", "prompt_tps_mean", "generation_tps_mean", "generation_tps_p50", "generation_tps_p95"]
QUALITY = f"""
  {r4("avg(comet_score)", "comet_mean")}, {r4("median(comet_score)", "comet_median")}, {r4("stddev_samp(comet_score)", "comet_stddev")}, {r4("avg(chrf_score)", "sentence_chrf_mean")},
  {r4(f"avg({PROT})", "protected_token_pass_rate")}, {r4(f"avg({REQ})", "required_term_pass_rate")},
  {r4("avg(CASE WHEN unnecessary_quotes = 'true' THEN 0.0 ELSE 1.0 END)", "format_pass_rate")},
  {r4("avg(CASE WHEN rule_check_status = 'PASS' THEN 1.0 ELSE 0.0 END)", "rule_pass_rate_all")},
  {r4(f"avg(CASE WHEN NOT ({OK}) THEN NULL WHEN rule_check_status = 'PASS' THEN 1.0 ELSE 0.0 END)", "rule_pass_rate_success_only")},
  {r4("avg(CASE WHEN rule_check_status = 'WARN' THEN 1.0 ELSE 0.0 END)", "rule_warn_rate")}, {r4("avg(CASE WHEN rule_check_status = 'FAIL' THEN 1.0 ELSE 0.0 END)", "rule_fail_rate")},
  {r4(f"avg({USE})", "human_usability_pass_rate")}, {r4(f"avg(CASE WHEN {CRIT} THEN 1.0 ELSE 0.0 END)", "critical_error_rate")}"""
QUALITY_COLUMNS = ["model_name", "comet_mean", "comet_median", "comet_stddev", "sentence_chrf_mean", "protected_token_pass_rate", "required_term_pass_rate", "format_pass_rate", "rule_pass_rate_all", "rule_pass_rate_success_only", "rule_warn_rate", "rule_fail_rate", "human_usability_pass_rate", "critical_error_rate"]


@query("model_speed_summary", f"{cte('facts')} SELECT model_name, {SPEED} FROM facts GROUP BY model_name")
def model_speed_summary(spark, sf_dir):
    return rounded(summaries.model_summary(facts(spark, sf_dir)).select(*SPEED_COLUMNS))


@query("model_accuracy_summary", f"{cte('facts')} SELECT model_name, {QUALITY} FROM facts WHERE run_id = '1' GROUP BY model_name")
def model_accuracy_summary(spark, sf_dir):
    return rounded(summaries.model_summary(facts(spark, sf_dir)).select(*QUALITY_COLUMNS))


@query("model_accuracy_all_runs", f"{cte('facts')} SELECT model_name, {QUALITY} FROM facts GROUP BY model_name")
def model_accuracy_all_runs(spark, sf_dir):
    return rounded(summaries.model_summary(facts(spark, sf_dir), accuracy_run=None).select(*QUALITY_COLUMNS))


@query("accuracy_run_fallback", f"{cte('facts')} SELECT model_name, {QUALITY} FROM facts GROUP BY model_name")
def accuracy_run_fallback(spark, sf_dir):
    """No row has this run, so all rows count."""
    return rounded(summaries.model_summary(facts(spark, sf_dir), accuracy_run="99").select(*QUALITY_COLUMNS))


QUALIFICATION_SQL = f"""{cte('facts')}, m AS (
  SELECT model_name, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END)::double AS sr, avg(CASE WHEN run_id = '1' THEN {PROT} END)::double AS pr,
    avg(CASE WHEN run_id = '1' THEN CASE WHEN unnecessary_quotes = 'true' THEN 0.0 ELSE 1.0 END END)::double AS fr,
    avg(CASE WHEN run_id = '1' THEN CASE WHEN {CRIT} THEN 1.0 ELSE 0.0 END END)::double AS cr,
    avg(CASE WHEN {EMPTY} THEN 1.0 ELSE 0.0 END)::double AS er FROM facts GROUP BY model_name
) SELECT model_name,
  CASE WHEN sr IS NULL OR pr IS NULL OR fr IS NULL OR cr IS NULL OR er IS NULL THEN 'INSUFFICIENT_DATA'
    WHEN sr < 0.75 OR pr < 0.85 OR fr < 0.93 OR cr > 0.35 OR er > 0.05 THEN 'FAIL' ELSE 'PASS' END AS qualification_status,
  concat_ws(',', CASE WHEN sr < 0.75 THEN 'success_rate' END, CASE WHEN pr < 0.85 THEN 'protected_token_pass_rate' END,
    CASE WHEN fr < 0.93 THEN 'format_pass_rate' END, CASE WHEN cr > 0.35 THEN 'critical_error_rate' END, CASE WHEN er > 0.05 THEN '_empty_output_rate' END) AS failed_metrics
FROM m"""
LOOSE = summaries.Thresholds(0.75, 0.85, 0.93, 0.35, 0.05)


@query("qualification_status", QUALIFICATION_SQL)
def qualification_status(spark, sf_dir):
    s = summaries.model_summary(facts(spark, sf_dir), thresholds=LOOSE)
    names = F.array_join(F.transform(F.filter(F.split("qualification_failure_reasons", ";"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1)), ",")
    return s.select("model_name", "qualification_status", names.alias("failed_metrics"))


GROUPED = f"""count(*) AS request_count, {r4("avg(comet_score)", "comet_mean")}, {r4("avg(chrf_score)", "sentence_chrf_mean")},
  {r4(f"avg({PROT})", "protected_token_pass_rate")}, {r4(f"avg({REQ})", "required_term_pass_rate")},
  {r4("avg(CASE WHEN rule_check_status = 'PASS' THEN 1.0 ELSE 0.0 END)", "rule_pass_rate")}, {r4(f"avg(CASE WHEN {CRIT} THEN 1.0 ELSE 0.0 END)", "critical_error_rate")},
  {r4(f"avg({LAT})", "latency_mean_ms")}, {r4(f"quantile_cont({LAT}, 0.5)", "latency_p50_ms")}, {r4(f"quantile_cont({LAT}, 0.95)", "latency_p95_ms")}"""


def grouped_sql(keys: list[str]) -> str:
    columns = ", ".join(k if k in keys else f"'' AS {k}" for k in ("model_name", "category", "subcategory", "difficulty", "input_variant"))
    return f"SELECT {columns}, {GROUPED} FROM facts GROUP BY {', '.join(keys)}"


for _name, _keys in (("category_summary", summaries.CATEGORY), ("subcategory_summary", summaries.SUBCATEGORY), ("difficulty_summary", summaries.DIFFICULTY)):
    query(_name, f"{cte('facts')} {grouped_sql(_keys)}")(lambda spark, sf_dir, keys=_keys: rounded(summaries.group_summary(facts(spark, sf_dir), keys)))

_parts = " UNION ALL ".join(f"SELECT '{n}' AS \"grouping\", * FROM ({grouped_sql(k)})" for n, k in (("category", summaries.CATEGORY), ("subcategory", summaries.SUBCATEGORY), ("difficulty", summaries.DIFFICULTY)))


@query("grouped_rollup", f"{cte('facts')} {_parts}")
def grouped_rollup(spark, sf_dir):
    return rounded(summaries.grouped_rollup(facts(spark, sf_dir)))


def noise_sql(keys: list[str]) -> str:
    side = lambda v: f"SELECT *, {PROT} AS prot, CASE WHEN rule_check_status = 'PASS' THEN 1.0 ELSE 0.0 END AS pass, CASE WHEN {CRIT} THEN 1.0 ELSE 0.0 END AS crit FROM facts WHERE input_variant = '{v}'"
    m = {"comet_mean": "comet_score", "chrf": "chrf_score", "protected_token_pass_rate": "prot", "rule_pass_rate": "pass", "critical_error_rate": "crit"}
    each = ", ".join(r4(f"avg({s}.{c})", f"{n}_{k}") for s, n in (("c", "clean"), ("n", "noise")) for k, c in m.items())
    drops = ", ".join(r4(f"{sign}(avg(c.{c}) - avg(n.{c}))", name) for name, c, sign in (("comet_drop", "comet_score", ""), ("chrf_drop", "chrf_score", ""), ("protected_token_pass_rate_drop", "prot", ""), ("rule_pass_rate_drop", "pass", ""), ("critical_error_rate_increase", "crit", "-")))
    by = ", ".join(f"c.{k}" for k in keys)
    return f"{cte('facts')}, c AS ({side('ocr_clean')}), n AS ({side('ocr_noise')}) SELECT {by}, count(*) AS pair_count, {each}, {drops} FROM c JOIN n ON c.model_name = n.model_name AND c.run_id = n.run_id AND c.id = n.id GROUP BY {by}"


@query("ocr_summary", noise_sql(["model_name"]))
def ocr_summary(spark, sf_dir):
    return rounded(summaries.noise_summary(facts(spark, sf_dir)))


@query("ocr_subcategory_summary", noise_sql(["model_name", "subcategory"]))
def ocr_subcategory_summary(spark, sf_dir):
    return rounded(summaries.noise_summary(facts(spark, sf_dir), True))


@query("ocr_unpaired", f"""{cte('facts')} SELECT 'WARNING' AS severity, model_name, '' AS file, model_name || '|' || run_id || '|' || id AS key, 'missing OCR clean/noise pair' AS issue
FROM facts WHERE input_variant IN ('ocr_clean', 'ocr_noise') GROUP BY model_name, run_id, id HAVING count(DISTINCT input_variant) < 2""")
def ocr_unpaired(spark, sf_dir):
    return summaries.unpaired(facts(spark, sf_dir))


STABILITY_SQL = f"""{cte('facts')}, items AS (
  SELECT model_name, id, input_variant, count(DISTINCT translation_ja) AS texts, stddev_samp(total_latency_ms) AS ls, stddev_samp(generation_tokens_per_second) AS ts
  FROM facts GROUP BY model_name, id, input_variant HAVING count(DISTINCT run_id) >= 2
) SELECT model_name, input_variant, count(*) AS multi_run_item_count, {r4("avg(CASE WHEN texts = 1 THEN 1.0 ELSE 0.0 END)", "exact_output_match_rate")},
  {r4("avg(texts)", "unique_translation_count_mean")}, {r4("avg(ls)", "latency_run_variation")}, {r4("avg(ts)", "generation_tps_run_variation")} FROM items GROUP BY model_name, input_variant"""


@query("stability_summary", STABILITY_SQL)
def stability_summary(spark, sf_dir):
    return rounded(summaries.stability_summary(facts(spark, sf_dir)))


@query("failed_cases", f"""{cte('facts')} SELECT model_name, run_id, id, category, subcategory, difficulty, input_variant, '' AS source_en, '' AS reference_ja, translation_ja, {r4("comet_score", "comet_score")}, rule_check_status, '' AS failure_reasons, '' AS human_comment
FROM facts WHERE {CRIT} OR protected_tokens_pass = 'false' OR comet_score < 0.1 OR human_usability_pass = 'false'""")
def failed_cases(spark, sf_dir):
    return rounded(summaries.failed_cases(facts(spark, sf_dir), 0.1))


FINAL_SQL = f"""{cte('facts')}, m AS (SELECT model_name, min(model_file) AS model_file, {SPEED} FROM facts GROUP BY model_name),
a AS (SELECT model_name, {QUALITY} FROM facts WHERE run_id = '1' GROUP BY model_name),
o AS (SELECT c.model_name, {r4("avg(c.comet_score) - avg(n.comet_score)", "ocr_comet_drop")} FROM facts c JOIN facts n ON c.model_name = n.model_name AND c.run_id = n.run_id AND c.id = n.id AND c.input_variant = 'ocr_clean' AND n.input_variant = 'ocr_noise' GROUP BY c.model_name),
items AS (SELECT model_name, id, input_variant, count(DISTINCT translation_ja) AS texts FROM facts GROUP BY model_name, id, input_variant HAVING count(DISTINCT run_id) >= 2),
v AS (SELECT model_name, min(input_variant) AS variant FROM items GROUP BY model_name),
s AS (SELECT items.model_name, {r4("avg(CASE WHEN texts = 1 THEN 1.0 ELSE 0.0 END)", "exact_output_match_rate")} FROM items JOIN v ON v.model_name = items.model_name AND variant = input_variant GROUP BY items.model_name)
SELECT m.model_name, model_file, '' AS quantization, request_count AS test_item_count, success_rate, comet_mean, cast(NULL as double) AS chrf_corpus, protected_token_pass_rate, required_term_pass_rate, format_pass_rate, critical_error_rate,
  human_usability_pass_rate, latency_p50_ms, latency_p95_ms, generation_tps_mean, '' AS peak_vram_mb, ocr_comet_drop, exact_output_match_rate, 'FAIL' AS qualification_status,
  row_number() OVER (ORDER BY critical_error_rate, -coalesce(nullif(human_usability_pass_rate, 0), -1), -coalesce(nullif(comet_mean, 0), -999), latency_p95_ms, m.model_name) AS final_rank
FROM m JOIN a ON a.model_name = m.model_name LEFT JOIN o ON o.model_name = m.model_name LEFT JOIN s ON s.model_name = m.model_name"""


@query("final_comparison", FINAL_SQL)
def final_comparison(spark, sf_dir):
    f = typed(facts(spark, sf_dir))
    out = summaries.final_comparison(summaries.model_summary(f), summaries.noise_summary(f), summaries.stability_summary(f))
    return rounded(summaries.final_rank(rounded(out)).drop("qualification_failure_reasons"))


# --- joins and data quality ---------------------------------------------------


def raw_side(f: DataFrame) -> DataFrame:
    return quality.keyed(f.where("event_id % 10 <> 3").select(*KEY, "request_success", "total_latency_ms", "category", F.lit("raw").alias("origin")))


def rule_side(f: DataFrame) -> DataFrame:
    blank = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.col("category"))
    return quality.keyed(f.where("event_id % 10 <> 7").select(*KEY, F.when(F.col("event_id") % 4 == 0, "false").otherwise(F.col("request_success")).alias("request_success"), "rule_check_status", blank.alias("category"), F.lit("rule").alias("origin")))


@query("merge_full_outer", f"""{cte('facts')}, raw AS (SELECT event_id, model_name, run_id, id, input_variant, request_success, total_latency_ms, category FROM facts WHERE event_id % 10 <> 3),
rule AS (SELECT event_id, model_name, run_id, id, input_variant, CASE WHEN event_id % 4 = 0 THEN 'false' ELSE request_success END AS request_success, rule_check_status, CASE WHEN event_id % 5 = 0 THEN '' ELSE category END AS category FROM facts WHERE event_id % 10 <> 7)
SELECT coalesce(b.model_name, a.model_name) AS model_name, coalesce(b.run_id, a.run_id) AS run_id, coalesce(b.id, a.id) AS id, coalesce(b.input_variant, a.input_variant) AS input_variant,
  CASE WHEN b.event_id IS NOT NULL THEN b.request_success ELSE a.request_success END AS request_success, {r4("a.total_latency_ms", "total_latency_ms")}, b.rule_check_status,
  CASE WHEN b.event_id IS NOT NULL THEN b.category ELSE a.category END AS category, CASE WHEN b.event_id IS NOT NULL THEN 'rule' ELSE 'raw' END AS origin
FROM raw a FULL JOIN rule b ON a.event_id = b.event_id""")
def merge_full_outer(spark, sf_dir):
    f = facts(spark, sf_dir)
    m = merge.full_merge([raw_side(f), rule_side(f)])
    return rounded(merge.fill_keys(m, set(m.columns)).select(*KEY, "request_success", "total_latency_ms", "rule_check_status", "category", "origin"))


def _integrity_sql(inside: str, outside: str, issue: str) -> str:
    return f"""{cte('facts')} SELECT 'ERROR' AS severity, model_name, '' AS file, model_name || '|' || run_id || '|' || id || '|' || input_variant AS key, '{issue}' AS issue FROM facts WHERE event_id % 10 <> {inside} AND event_id % 10 = {outside}"""


@query("integrity_raw_only", _integrity_sql("3", "7", "raw row has no matching rule_evaluation row"))
def integrity_raw_only(spark, sf_dir):
    f = facts(spark, sf_dir)
    return quality.without_partner(raw_side(f), rule_side(f)).where("issue like 'raw%'")


@query("integrity_rule_only", _integrity_sql("7", "3", "rule_evaluation row has no matching raw row"))
def integrity_rule_only(spark, sf_dir):
    f = facts(spark, sf_dir)
    return quality.without_partner(raw_side(f), rule_side(f)).where("issue like 'rule%'")


def repeated(f: DataFrame) -> DataFrame:
    one = f.select(*KEY, "total_latency_ms", "event_id", F.lit("a.csv").alias("file"), F.col("event_id").alias("record_no"))
    two = one.where("event_id % 6 = 0").withColumns({"file": F.lit("b.csv"), "total_latency_ms": F.col("total_latency_ms") + 1})
    return quality.keyed(one.unionByName(two))


@query("dedup_first_wins", f"{cte('facts')} SELECT model_name, run_id, id, input_variant, {r4('total_latency_ms', 'total_latency_ms')}, 'a.csv' AS file FROM facts")
def dedup_first_wins(spark, sf_dir):
    kept, _ = quality.first_wins(repeated(facts(spark, sf_dir)), "raw", ["file", "record_no"])
    return rounded(kept.select(*KEY, "total_latency_ms", "file"))


@query("duplicate_report", f"{cte('facts')} SELECT 'ERROR' AS severity, model_name, 'b.csv' AS file, model_name || '|' || run_id || '|' || id || '|' || input_variant AS key, 'raw: duplicate composite key' AS issue FROM facts WHERE event_id % 6 = 0")
def duplicate_report(spark, sf_dir):
    return quality.first_wins(repeated(facts(spark, sf_dir)), "raw", ["file", "record_no"])[1]


@query("item_set_diff", f"""{cte('facts')}, items AS (SELECT DISTINCT bundle, id, input_variant FROM facts WHERE NOT (bundle = 'model-2' AND event_id % 36 < 20) AND NOT (bundle = 'model-0' AND category = 'category-3')),
base AS (SELECT id, input_variant FROM items WHERE bundle = 'model-0'), others AS (SELECT DISTINCT bundle FROM items WHERE bundle <> 'model-0'),
missing AS (SELECT o.bundle, count(*) AS n FROM others o CROSS JOIN base b WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.bundle = o.bundle AND i.id = b.id AND i.input_variant = b.input_variant) GROUP BY o.bundle),
extra AS (SELECT i.bundle, count(*) AS n FROM items i WHERE i.bundle <> 'model-0' AND NOT EXISTS (SELECT 1 FROM base b WHERE i.id = b.id AND i.input_variant = b.input_variant) GROUP BY i.bundle)
SELECT 'WARNING' AS severity, bundle AS model_name, '' AS file, '' AS key, 'missing ' || n || ' items compared with model-0' AS issue FROM missing
UNION ALL SELECT 'WARNING', bundle, '', '', 'extra ' || n || ' items compared with model-0' FROM extra""")
def item_set_diff(spark, sf_dir):
    f = facts(spark, sf_dir).where("NOT (bundle = 'model-2' AND event_id % 36 < 20) AND NOT (bundle = 'model-0' AND category = 'category-3')")
    return quality.item_set_diff(f)


@query("quality_ranges", f"""{cte('facts')}, s AS (SELECT model_name, model_name || '|' || run_id || '|' || id || '|' || input_variant AS key, total_latency_ms - 5 AS lat, comet_score * 3 - 1.2 AS comet, chrf_score * 3 - 2 AS chrf FROM facts)
SELECT 'WARNING' AS severity, model_name, '' AS file, key, 'negative latency' AS issue FROM s WHERE lat < 0
UNION ALL SELECT 'WARNING', model_name, '', key, 'COMET score outside expected range' FROM s WHERE NOT (comet BETWEEN -1.0 AND 1.5)
UNION ALL SELECT 'WARNING', model_name, '', key, 'chrF score outside expected range' FROM s WHERE NOT (chrf BETWEEN 0.0 AND 100.0)""")
def quality_ranges(spark, sf_dir):
    f = facts(spark, sf_dir).selectExpr(*KEY, "total_latency_ms - 5 AS total_latency_ms", "comet_score * 3 - double('1.2') AS comet_score", "chrf_score * 3 - 2 AS chrf_score")
    return quality.negative_latency(f).unionByName(quality.score_range(f, "comet", "comet_score")).unionByName(quality.score_range(f, "chrf", "chrf_score"))


@query("resume_pending", f"{cte('facts')} SELECT model_name, run_id, id, input_variant FROM facts WHERE NOT (event_id % 4 = 0 AND {OK})")
def resume_pending(spark, sf_dir):
    f = facts(spark, sf_dir)
    return inputs.pending(f.select(*KEY), f.where("event_id % 4 = 0"), KEY, retry_failed=True)


@query("readiness", f"""{cte('facts')} SELECT input_variant, count(*) AS row_count, count(DISTINCT id) AS id_count, count(*) FILTER (NOT ({OK})) AS failed_count, count(*) FILTER ({EMPTY}) AS blank_count, count(*) - count(DISTINCT id) AS duplicate_count, false AS ready FROM facts GROUP BY input_variant""")
def readiness(spark, sf_dir):
    return rounded(quality.readiness(facts(spark, sf_dir), {"standard": 400, "ocr_clean": 40, "ocr_noise": 40}))


@query("category_sizes", f"""{cte('pairs')}, want(category, expected) AS (VALUES ('category-0', 80), ('category-1', 100), ('category-2', 100), ('category-3', 50), ('category-4', 30), ('category-9', 40)), have AS (SELECT category, count(*) AS actual FROM pairs GROUP BY category)
SELECT coalesce(w.category, h.category) AS category, coalesce(expected, 0)::bigint AS expected, coalesce(actual, 0) AS actual, coalesce(expected, 0) = coalesce(actual, 0) AS matches FROM want w FULL JOIN have h ON w.category = h.category""")
def category_sizes(spark, sf_dir):
    return quality.category_sizes(view(spark, sf_dir, "pairs"), {"category-0": 80, "category-1": 100, "category-2": 100, "category-3": 50, "category-4": 30, "category-9": 40})


@query("running_throughput", """SELECT event_id, event_type, done_count, round(batch_total_time_ms, 3) AS batch_total_time_ms, CASE WHEN batch_total_time_ms > 0 THEN round(done_count * 1000 / batch_total_time_ms, 4) END AS requests_per_second FROM (
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done_count, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type))) / 1000.0::double AS batch_total_time_ms FROM events)""")
def running_throughput(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"))
    out = quality.running_throughput(e, ["event_type"], order="event_id")
    return out.select("event_id", "event_type", F.col("done_count").cast("long").alias("done_count"), F.round("batch_total_time_ms", 3).alias("batch_total_time_ms"), F.round("requests_per_second", 4).alias("requests_per_second"))


# --- items, prompts, responses -------------------------------------------------


def items(spark, sf_dir) -> DataFrame:
    """Items with flaws put in by id."""
    return view(spark, sf_dir, "pairs").selectExpr("conv_id * 1000 + turn AS line_no", "CASE WHEN conv_id % 15 = 2 THEN '' WHEN conv_id % 10 = 1 THEN 'same-' || (conv_id % 4) ELSE id END AS id", "category", "subcategory", "difficulty", "CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE source_en END AS source_en", "reference_ja", "CASE WHEN conv_id % 8 = 0 THEN '' ELSE context_ja END AS context_ja", "clean_source_en", "protected_tokens", "required_terms", "evaluation_focus")


ITEMS_CTE = f"""{cte('pairs')}, items AS (SELECT conv_id * 1000 + turn AS line_no, CASE WHEN conv_id % 15 = 2 THEN '' WHEN conv_id % 10 = 1 THEN 'same-' || (conv_id % 4) ELSE id END AS id, category, subcategory, difficulty, CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE source_en END AS source_en, reference_ja, CASE WHEN conv_id % 8 = 0 THEN '' ELSE context_ja END AS context_ja, clean_source_en, required_terms FROM pairs)"""


@query("input_validation", f"""{ITEMS_CTE} SELECT line_no, id, concat_ws(', ', CASE WHEN trim(id) = '' THEN 'id is empty' END, CASE WHEN trim(id) <> '' AND row_number() OVER (PARTITION BY trim(id) ORDER BY line_no) > 1 THEN 'duplicate id' END,
CASE WHEN trim(source_en) = '' THEN 'source_en is empty' END, CASE WHEN trim(reference_ja) = '' THEN 'reference_ja is empty' END, CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'invalid difficulty' END, CASE WHEN trim(context_ja) = '' THEN 'context_ja is empty' END) AS errors FROM items""")
def input_validation(spark, sf_dir):
    return inputs.violations(items(spark, sf_dir), "context").select("line_no", "id", F.concat_ws(", ", "errors").alias("errors"))


@query("input_selection", f"""{ITEMS_CTE}, p AS (SELECT line_no, category, row_number() OVER (ORDER BY line_no) AS k FROM items WHERE category IN ('category-1', 'category-3')) SELECT line_no, category FROM p WHERE k BETWEEN 5 AND 40""")
def input_selection(spark, sf_dir):
    return inputs.select_items(items(spark, sf_dir), categories=["category-1", "category-3"], start=5, end=40).select("line_no", "category")


PROMPT = "CASE input_variant WHEN 'context' THEN 'Context:' || chr(10) || context_ja || chr(10) || chr(10) || 'Text:' || chr(10) || source_en WHEN 'terminology' THEN 'Terminology:' || chr(10) || required_terms || chr(10) || chr(10) || 'Text:' || chr(10) || source_en ELSE source_en END"


@query("prompt_text", f"{cte('pairs')} SELECT id, input_variant, {PROMPT} AS input_text FROM pairs")
def prompt_text(spark, sf_dir):
    return view(spark, sf_dir, "pairs").select("id", "input_variant", inputs.input_text(F.col("input_variant")).alias("input_text"))


@query("request_payload_json", f"{cte('pairs')} SELECT id, 'm' AS model, {PROMPT} AS user_text, 256 AS max_tokens, 40 AS top_k, cast(NULL as varchar) AS min_p FROM pairs")
def request_payload_json(spark, sf_dir):
    p = view(spark, sf_dir, "pairs").withColumn("input_text", inputs.input_text(F.col("input_variant"))).withColumn("body", inputs.payload("m", inputs.SYSTEM_PROMPT, top_k=40, min_p=None))
    g = lambda path: F.get_json_object("body", path)
    return p.select("id", g("$.model").alias("model"), g("$.messages[1].content").alias("user_text"), g("$.max_tokens").cast("int").alias("max_tokens"), g("$.top_k").cast("int").alias("top_k"), g("$.min_p").alias("min_p"))


BODY = """CASE event_id % 6 WHEN 0 THEN '{"choices":[{"message":{"content":" ' || event_type || ' "},"finish_reason":"stop"}],"usage":{"prompt_tokens":' || event_id || ',"completion_tokens":5,"total_tokens":7},"timings":{"prompt_ms":1.5,"predicted_per_second":20.0}}'
 WHEN 1 THEN '{"choices":[{"text":"' || event_type || '"}],"timings":{"prompt_n":' || event_id || ',"predicted_n":9}}'
 WHEN 2 THEN '{"choices":[]}'
 WHEN 3 THEN '{"choices":[{"message":{"content":""}}]}'
 WHEN 4 THEN '{"choices":[{"message":{"content":"","reasoning":"think"},"finish_reason":"length"}]}'
 ELSE '{"choices":[{"message":{}}]}' END"""


@query("response_fields", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE '' END AS said, CASE event_id % 6 WHEN 4 THEN 'think' ELSE '' END AS reasoning_content,
CASE event_id % 6 WHEN 0 THEN 'stop' WHEN 4 THEN 'length' ELSE '' END AS finish_reason, CASE WHEN event_id % 6 IN (0, 1) THEN event_id END AS prompt_tokens, CASE event_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 9 END::bigint AS completion_tokens,
CASE event_id % 6 WHEN 2 THEN 'missing_field' WHEN 3 THEN 'empty_response' WHEN 5 THEN 'missing_field' ELSE '' END AS error_type FROM events""")
def response_fields(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{BODY} AS raw_response")
    out = responses.parse_responses(e)
    return out.select("event_id", F.when(F.col("event_id") % 6 != 2, F.col("translation_ja")).alias("said"), "reasoning_content", "finish_reason", "prompt_tokens", "completion_tokens", "error_type")


STREAM = """'data: {"choices":[{"delta":{"content":"' || event_type || '"}}]}' || chr(10) || chr(10) || 'data: {"choices":[{"delta":{"content":"-' || event_id || '"}}]}' || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'data: not json' || chr(10) ELSE '' END
 || 'data: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"completion_tokens":' || event_id || '}}' || chr(10) || 'data: [DONE]' || chr(10) || 'data: {"choices":[{"delta":{"content":"late"}}]}'"""


@query("sse_replay", "SELECT event_id, event_type || '-' || event_id AS content, 'stop' AS finish_reason, event_id AS completion_tokens, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS bad FROM events")
def sse_replay(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "event_type", f"{STREAM} AS raw").withColumn("s", responses.replay_stream(F.col("raw")))
    return e.select("event_id", "s.content", "s.finish_reason", F.col("s.usage.completion_tokens").alias("completion_tokens"), "s.bad")


@query("run_console_summary", f"""{cte('facts')}, g AS (SELECT model_name, run_id, count(*) AS total_items, count(*) FILTER ({OK}) AS success_count, list_sort(list({LAT}) FILTER ({OK})) AS a, avg({LAT}) AS m, median({LAT}) AS p50, avg({GEN}) AS g FROM facts GROUP BY model_name, run_id),
q AS (SELECT *, len(a) AS n, (19 * (len(a) + 1)) // 20 AS j, (19 * (len(a) + 1)) % 20 AS d FROM g)
SELECT model_name, run_id, total_items, success_count, total_items - success_count AS failure_count, {r4("100.0 * success_count / total_items", "success_rate_percent")}, {r4("m", "avg_latency_ms")}, {r4("p50", "p50_latency_ms")},
{r4("CASE WHEN n >= 20 THEN (a[j] * (20 - d) + a[j + 1] * d) / 20 ELSE a[n] END", "p95_latency_ms")}, {r4("g", "avg_generation_tokens_per_second")} FROM q""")
def run_console_summary(spark, sf_dir):
    return rounded(summaries.run_summary(facts(spark, sf_dir), ["model_name", "run_id"]))


# --- text rules ------------------------------------------------------------------

SQUEEZE = "regexp_replace(trim(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12)), '[ \\t\\f\\x0B]+', ' ', 'g')"


@query("protected_token_recall", f"""{cte('pairs')}, t AS (SELECT id, translation_ja AS t, list_filter(list_transform(string_split(protected_tokens, ';'), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> '') AS toks FROM pairs),
u AS (SELECT id, t, toks, unnest(list_distinct(toks)) AS k FROM t),
c AS (SELECT id, len(toks) AS expected, k, len(list_filter(toks, lambda x: x = k)) AS c, CASE WHEN regexp_full_match(k, '[0-9]+(\\.[0-9]+)?') THEN len(list_filter(regexp_extract_all(t, '[0-9.]+'), lambda r: r = k)) ELSE (length(t) - length(replace(t, k, ''))) // length(k) END AS n FROM u)
SELECT id, max(expected)::bigint AS expected, sum(least(n, c))::bigint AS matched, max(expected) = sum(least(n, c)) AS passed FROM c GROUP BY id""")
def protected_token_recall(spark, sf_dir):
    p = view(spark, sf_dir, "pairs")
    r = rules.recall(F.col("translation_ja"), rules.split_semicolon(F.col("protected_tokens")))
    return p.withColumn("r", r).select("id", F.col("r.expected").cast("long").alias("expected"), F.col("r.matched").cast("long").alias("matched"), (F.col("r.expected") == F.col("r.matched")).alias("passed"))


@query("required_term_recall", f"""{cte('pairs')}, t AS (SELECT id, translation_ja AS t, list_filter(list_transform(list_filter(string_split(required_terms, ';'), lambda p: contains(p, '=')), lambda p: trim(substr(p, instr(p, '=') + 1), ' ' || chr(10))), lambda p: p <> '') AS toks FROM pairs),
u AS (SELECT id, t, toks, unnest(CASE WHEN len(toks) = 0 THEN [NULL] ELSE list_distinct(toks) END) AS k FROM t),
c AS (SELECT id, len(toks) AS expected, len(list_filter(toks, lambda x: x = k)) AS c, coalesce((length(t) - length(replace(t, k, ''))) // length(k), 0) AS n FROM u)
SELECT id, max(expected)::bigint AS expected, coalesce(sum(CASE WHEN c > 0 THEN least(n, c) ELSE 0 END), 0)::bigint AS matched FROM c GROUP BY id""")
def required_term_recall(spark, sf_dir):
    p = view(spark, sf_dir, "pairs")
    terms = rules.terms_of(rules.split_semicolon(F.col("required_terms")))
    r = rules.recall(F.col("translation_ja"), F.transform(terms, lambda t: t["target"]), rules.substring_count)
    return p.withColumn("r", r).select("id", F.col("r.expected").cast("long").alias("expected"), F.col("r.matched").cast("long").alias("matched"))


def marked(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "marked").withColumn("t", rules.squeeze("body"))


MARKED = f"{cte('marked')}, m AS (SELECT *, {SQUEEZE.format(c='body')} AS t FROM marked)"


@query("extra_text", MARKED + r""" SELECT doc_id, CASE WHEN regexp_matches(t, '(?im)^\s*翻訳\s*[:：]') THEN '^\s*翻訳\s*[:：]' WHEN regexp_matches(t, '(?im)^\s*日本語訳\s*[:：]') THEN '^\s*日本語訳\s*[:：]' WHEN contains(t, '以下が翻訳です') THEN '以下が翻訳です'
WHEN regexp_matches(t, '(?im)^\s*Translation\s*:') THEN '^\s*Translation\s*:' WHEN regexp_matches(t, '(?im)The Japanese translation is\s*:') THEN 'The Japanese translation is\s*:' WHEN regexp_matches(t, '(?im)Here is the translation\s*:') THEN 'Here is the translation\s*:' ELSE '' END AS pattern FROM m""")
def extra_text(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", rules.extra_text(F.col("t")).alias("pattern"))


@query("markdown", MARKED + r""" SELECT doc_id, contains(t, '```') OR regexp_matches(t, '(?m)^\s{0,3}#{1,6}\s+\S') OR regexp_matches(t, '(?m)^\s{0,3}[-*+]\s+\S') OR regexp_matches(t, '(?m)^\s{0,3}[0-9]+\.\s+\S') OR regexp_matches(t, '(?m)^\s{0,3}>\s+\S') OR regexp_matches(t, '(\*\*|__)[^*_]+(\*\*|__)') AS markdown_detected FROM m""")
def markdown(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", rules.has_markdown(F.col("t")).alias("markdown_detected"))


@query("quotes", MARKED + """ SELECT doc_id, length(t) >= 2 AND ((starts_with(t, '"') AND suffix(t, '"')) OR (starts_with(t, '''') AND suffix(t, '''')) OR (starts_with(t, '「') AND suffix(t, '」')) OR (starts_with(t, '『') AND suffix(t, '』'))) AS unnecessary_quotes FROM m""")
def quotes(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", rules.is_quoted(F.col("t")).alias("unnecessary_quotes"))


@query("excessive_length", MARKED + f""", n AS (SELECT doc_id, length(t) AS o, length({SQUEEZE.format(c='reference_ja')}) AS r, length(substr(t, 1, cast(doc_id % 70 as int))) AS s FROM m)
SELECT doc_id, o AS output_length, r AS reference_length, CASE WHEN r > 0 THEN round(o / r::double, 4) END AS output_length_ratio, (r > 0 AND o >= 80 AND o / r::double > 4) OR (s <= 40 AND o >= 160) AS excessive_length FROM n""")
def excessive_length(spark, sf_dir):
    m = marked(spark, sf_dir).select("doc_id", F.length("t").alias("o"), F.length(rules.squeeze("reference_ja")).alias("r"), F.length(F.substring("t", F.lit(1), (F.col("doc_id") % 70).cast("int"))).alias("s"))
    m = m.withColumn("e", rules.excess(F.col("o"), F.col("r"), F.col("s"), rules.RuleConfig()))
    return m.select("doc_id", F.col("o").cast("long").alias("output_length"), F.col("r").cast("long").alias("reference_length"), F.round("e.ratio", 4).alias("output_length_ratio"), F.col("e.excessive").alias("excessive_length"))


_allowed = ", ".join(f"'{t.lower()}'" for t in rules.ALLOWED_TERMS)


@query("english_residue", f"""{cte('pairs')}, w AS (SELECT id, translation_ja AS t, list_filter(regexp_extract_all(translation_ja, '[A-Za-z][A-Za-z0-9_''-]*'), lambda x: NOT list_contains([{_allowed}], lower(x))) AS odd,
  length(regexp_replace(translation_ja, '\\s+', '', 'g')) AS n, length(translation_ja) - length(regexp_replace(translation_ja, '[A-Za-z]', '', 'g')) AS letters FROM pairs)
SELECT id, round(coalesce(letters / nullif(n, 0)::double, 0), 4) AS english_character_ratio, len(odd) >= 4 OR coalesce(letters / nullif(n, 0)::double, 0) >= 0.35 AS english_residue_detected FROM w""")
def english_residue(spark, sf_dir):
    config = rules.RuleConfig()
    none = F.array().cast("array<string>")
    allowed = rules.allowed_terms(none, F.array().cast("array<struct<source:string,target:string>>"), F.lit(""), config)
    p = view(spark, sf_dir, "pairs").withColumn("r", rules.residue(F.col("translation_ja"), allowed, F.lit(0), config))
    return p.select("id", F.round("r.ratio", 4).alias("english_character_ratio"), F.col("r.detected").alias("english_residue_detected"))


# the longest run that ends at a place is at most one longer than any before, so one pass over the places finds it
@query("longest_source_match", f"""{cte('pairs')}, t AS (SELECT id, lower(source_en) AS a, lower(translation_ja) AS b FROM pairs)
SELECT id, list_reduce(list_prepend(0::bigint, range(1, length(a) + 1)), lambda n, i: CASE WHEN contains(b, substr(a, i - n, n + 1)) THEN n + 1 ELSE n END)::int AS longest_source_match FROM t""")
def longest_source_match(spark, sf_dir):
    return view(spark, sf_dir, "pairs").select("id", rules.longest_source_match(F.col("source_en"), F.col("translation_ja")).alias("longest_source_match"))


_LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ" * 2
_scripted = {c: f"CASE conv_id % 5 WHEN 2 THEN translate({c}, '{_LATIN}', '{_KANA}') ELSE {c} END" for c in ("translation_ja", "protected_tokens", "required_terms")}


def evaluated(spark, sf_dir) -> DataFrame:
    """The rules over all pairs, a fifth of the outputs in another script, letter by letter."""
    pairs = view(spark, sf_dir, "pairs").withColumns({c: F.expr(e) for c, e in _scripted.items()})
    raw = pairs.selectExpr("*", "CASE conv_id % 7 WHEN 0 THEN 'false' ELSE 'true' END AS request_success", "CASE conv_id % 11 WHEN 0 THEN 500 ELSE 200 END AS http_status", "CASE conv_id % 13 WHEN 0 THEN 'length' ELSE 'stop' END AS finish_reason", "'' AS error", "CASE conv_id % 17 WHEN 0 THEN 'timeout' ELSE '' END AS error_type")
    return rules.apply_rules(raw)


@query("request_reasons", f"""{cte('pairs')} SELECT id, concat_ws(';', CASE WHEN conv_id % 7 = 0 THEN 'request_success=false' END, CASE WHEN conv_id % 11 = 0 THEN 'http_status=500' END, CASE WHEN conv_id % 17 = 0 THEN 'timeout' END, CASE WHEN lower(trim(translation_ja, ' ' || chr(10))) IN ('', 'null', 'none', 'nan') THEN 'empty_output' END, CASE WHEN conv_id % 13 = 0 THEN 'finish_reason=length' END) AS request_error_type,
NOT (conv_id % 7 = 0 OR conv_id % 11 = 0 OR conv_id % 17 = 0 OR conv_id % 13 = 0 OR lower(trim(translation_ja, ' ' || chr(10))) IN ('', 'null', 'none', 'nan')) AS request_success FROM pairs""")
def request_reasons(spark, sf_dir):
    return evaluated(spark, sf_dir).select("id", "request_error_type", "request_success")


_squeezed = lambda c: SQUEEZE.format(c=c)
_parts = lambda c: f"list_filter(list_transform(string_split({c}, ';'), lambda p: {_squeezed('p')}), lambda p: p <> '')"
_term = "{{'source': {a}, 'target': {b}}}".format(a=_squeezed("left(p, instr(p, '=') - 1)"), b=_squeezed("substr(p, instr(p, '=') + 1)"))
_number = "regexp_full_match(k, '[0-9]+(\\.[0-9]+)?%?')"
_longest = "list_reduce(list_prepend(0::bigint, range(1, length(s) + 1)), lambda n, i: CASE WHEN contains(lower(t), lower(substr(s, i - n, n + 1))) THEN n + 1 ELSE n END)::int"
_found = f"CASE WHEN {_number} AND k LIKE '%\\%' ESCAPE '\\' THEN len(list_filter(regexp_extract_all(t || ' ', '([0-9.]+%)[^0-9.]', 1), lambda r: r = k)) WHEN {_number} THEN len(list_filter(regexp_extract_all(t, '[0-9.]+'), lambda r: r = k)) ELSE (length(t) - length(replace(t, k, ''))) // length(k) END"
_extra = " OR ".join(f"regexp_matches(t, '(?im){p}')" for p in rules.EXTRA_TEXT)
_marks = " OR ".join(f"regexp_matches(t, '{p}')" for p in rules.MARKDOWN)
_quoted = " OR ".join(f"(starts_with(t, '{a}') AND suffix(t, '{b}'))" for a, b in (tuple(q.replace("'", "''") for q in pair) for pair in rules.QUOTES))
JUDGED = f"""{cte('pairs')}, c AS (SELECT *, {_squeezed('translation_ja')} AS t, {_squeezed('source_en')} AS s, {_squeezed('reference_ja')} AS r, {_parts('protected_tokens')} AS toks, list_filter(list_transform(list_filter({_parts('required_terms')}, lambda p: contains(p, '=')), lambda p: {_term}), lambda x: x.target <> '') AS terms FROM (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _scripted.items())}) FROM pairs)),
tok AS (SELECT id, t, k, count(*) AS c FROM (SELECT id, t, unnest(toks) AS k FROM c) GROUP BY ALL),
lost AS (SELECT DISTINCT id FROM tok WHERE {_found} < c),
want AS (SELECT id, t, k, count(*) AS c FROM (SELECT id, t, unnest(list_transform(terms, lambda x: x.target)) AS k FROM c) GROUP BY ALL),
short AS (SELECT DISTINCT id FROM want WHERE (length(t) - length(replace(t, k, ''))) // length(k) < c),
e AS (SELECT id, conv_id, input_variant, t, length(t) AS o, length(r) AS f, length(s) AS n, lower(t) IN ('', 'null', 'none', 'nan') AS empty, CASE WHEN t = '' OR s = '' THEN 0 ELSE {_longest} END AS longest,
  length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '\\s+', '', 'g')) AS compact,
  list_concat([{_allowed}], list_transform(list_filter(toks, lambda p: regexp_matches(p, '[A-Za-z]')), lambda p: lower(p)), list_transform(terms, lambda x: lower(x.source)), list_transform(regexp_extract_all(s, '{rules.PLACEHOLDER}'), lambda p: lower(p))) AS allowed FROM c),
j AS (SELECT *, conv_id % 7 = 0 OR conv_id % 11 = 0 OR conv_id % 13 = 0 OR conv_id % 17 = 0 OR empty AS failed, id IN (SELECT id FROM short) AS unmet,
  len(list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_''-]*'), lambda w: NOT list_contains(allowed, lower(w)))) >= 4 OR coalesce(letters / nullif(compact, 0)::double, 0) >= 0.35 OR longest >= 20 AS residue FROM e),
v AS (SELECT *, concat_ws(';', CASE WHEN failed THEN 'request_success=false' END, CASE WHEN empty THEN 'empty_output' END, CASE WHEN id IN (SELECT id FROM lost) THEN 'protected_tokens_missing' END, CASE WHEN {_extra} THEN 'extra_text_detected' END, CASE WHEN {_marks} THEN 'markdown_detected' END,
  CASE WHEN (f > 0 AND o >= 80 AND o / f::double > 4) OR (n <= 40 AND o >= 160) THEN 'excessive_length' END, CASE WHEN unmet AND input_variant = 'terminology' THEN 'required_terms_missing' END) AS failure_reasons,
  concat_ws(';', CASE WHEN unmet AND input_variant <> 'terminology' THEN 'required_terms_missing' END, CASE WHEN length(t) >= 2 AND ({_quoted}) THEN 'unnecessary_quotes' END, CASE WHEN residue THEN 'english_residue_detected' END) AS warning_reasons FROM j),
judged AS (SELECT id, CASE WHEN failure_reasons <> '' THEN 'FAIL' WHEN warning_reasons <> '' THEN 'WARN' ELSE 'PASS' END AS rule_check_status, failure_reasons, warning_reasons, NOT failed AS request_success, longest AS longest_source_match FROM v)"""


@query("rule_status", f"{JUDGED} SELECT * FROM judged")
def rule_status(spark, sf_dir):
    """All rules together; the turns hold no character with a compatibility form, which the SQL does not fold."""
    return evaluated(spark, sf_dir).select("id", "rule_check_status", "failure_reasons", "warning_reasons", "request_success", "longest_source_match")


@query("status_counts", f"{JUDGED} SELECT rule_check_status, count(*) AS row_count FROM judged GROUP BY rule_check_status")
def status_counts(spark, sf_dir):
    return rules.status_counts(evaluated(spark, sf_dir))


@query("normalize_text", r"SELECT doc_id, regexp_replace(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\r\n?', chr(10), 'g'), ' ' || chr(9) || chr(10)), '[ \t\f\x0B]+', ' ', 'g') AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    """All texts.  The SQL reads all of them too but knows NFC alone, so it differs where a character has a compatibility form."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", rules.normalize_text("text").alias("normalized"))


@query("typed_values", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN cast(event_id as double) WHEN 2 THEN -0.5 WHEN 7 THEN 1000.0 END AS number, CASE event_id % 8 WHEN 0 THEN event_id WHEN 2 THEN 0 WHEN 7 THEN 1000 END AS whole, CASE event_id % 8 WHEN 3 THEN true WHEN 4 THEN false END AS flag FROM events""")
def typed_values(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CASE event_id % 8 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN 'nan' WHEN 2 THEN '-.5' WHEN 3 THEN ' Yes' WHEN 4 THEN 'NG' WHEN 5 THEN '1d' WHEN 6 THEN 'inf' ELSE '1e3' END AS c")
    return e.select("event_id", as_float("c").alias("number"), to_int("c").alias("whole"), F.when(~F.col("c").rlike("^ ?[0-9]+ ?$"), as_bool("c")).alias("flag"))


# --- corpus scores and review samples ----------------------------------------------


_chars = "list_transform(range(1, greatest(length({c}) - {n} + 2, 1)), lambda i: {{'o': {o}, 'g': substr({c}, i, {n})}})"
_words = "list_transform(range(1, greatest(len({c}) - {n} + 2, 1)), lambda i: {{'o': {o}, 'g': array_to_string({c}[i : i + {n} - 1], chr(31))}})"
_grams = lambda c, w: " || ".join([_chars.format(c=c, n=n, o=n) for n in range(1, 7)] + [_words.format(c=w, n=n, o=6 + n) for n in (1, 2)])
_mark = "'[!-/:-@\\[-`{|}~]'"
_cut = f"CASE WHEN length(w) > 1 AND regexp_matches(right(w, 1), {_mark}) THEN [left(w, length(w) - 1), right(w, 1)] WHEN length(w) > 1 AND regexp_matches(left(w, 1), {_mark}) THEN [left(w, 1), substr(w, 2)] ELSE [w] END"
_tokens = lambda t: f"flatten(list_transform(list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> ''), lambda w: {_cut}))"
CHRF = f"""{cte('pairs')}, seg AS (SELECT id, input_variant, regexp_replace(translation_ja, '\\s+', '', 'g') AS hc, regexp_replace(reference_ja, '\\s+', '', 'g') AS rc, {_tokens('translation_ja')} AS hw, {_tokens('reference_ja')} AS rw FROM pairs),
g AS (SELECT id, input_variant, 1 AS h, 0 AS r, unnest({_grams('hc', 'hw')}) AS e FROM seg UNION ALL SELECT id, input_variant, 0, 1, unnest({_grams('rc', 'rw')}) FROM seg),
c AS (SELECT id, input_variant, e.o AS o, e.g AS g, sum(h) AS h, sum(r) AS r FROM g GROUP BY ALL),
s AS (SELECT input_variant, o, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM c GROUP BY ALL HAVING sum(h) > 0 AND sum(r) > 0),
a AS (SELECT input_variant, avg(m / h::double) AS p, avg(m / r::double) AS q FROM s GROUP BY input_variant),
score AS (SELECT input_variant, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 4) + 0.0::double AS chrf FROM a)"""


@query("chrf_corpus", f"{CHRF} SELECT input_variant, chrf FROM score")
def chrf_corpus(spark, sf_dir):
    p = view(spark, sf_dir, "pairs").select("input_variant", F.col("translation_ja").alias("hypothesis"), F.col("reference_ja").alias("reference"))
    return rounded(chrf.corpus_chrf(p, ["input_variant"]))


@query("chrf_drop", f"{CHRF} SELECT round(max(CASE WHEN input_variant = 'standard' THEN chrf END) - max(CASE WHEN input_variant = 'context' THEN chrf END), 4) + 0.0::double AS chrf_drop FROM score")
def chrf_drop(spark, sf_dir):
    c = chrf_corpus(spark, sf_dir)
    return rounded(c.agg((F.max(F.when(F.col("input_variant") == "standard", F.col("chrf"))) - F.max(F.when(F.col("input_variant") == "context", F.col("chrf")))).alias("chrf_drop")))


@query("score_summary", f"{cte('facts')} SELECT model_name, input_variant, count(*) AS row_count, count(comet_score) AS comet_count, {r4('avg(comet_score)', 'comet_mean')}, {r4('avg(chrf_score)', 'sentence_chrf_mean')} FROM facts GROUP BY model_name, input_variant")
def score_summary(spark, sf_dir):
    return rounded(summaries.corpus_score_summary(facts(spark, sf_dir)))


# bytes: the SQL function counts them; divergence is rounded as the operator does
MEAN_DISTANCE = "round(avg(coalesce(levenshtein(x.t, y.t)::double / nullif(greatest(octet_length(encode(x.t)), octet_length(encode(y.t))), 0), 0.0)), 9)"


@query("review_sample", f"""{cte('facts')}, d AS (SELECT *, md5(id || '|' || run_id || '|' || input_variant || '|42') AS draw FROM facts),
low AS (SELECT model_name AS m, quantile_cont(comet_score, 0.2) AS bound FROM facts GROUP BY model_name),
said AS (SELECT id, input_variant, model_name, min(translation_ja) AS t FROM facts WHERE run_id = '1' GROUP BY ALL),
apart AS (SELECT x.id AS i, x.input_variant AS v, {MEAN_DISTANCE} AS divergence FROM said x JOIN said y ON x.id = y.id AND x.input_variant = y.input_variant AND x.model_name < y.model_name GROUP BY ALL),
texts AS (SELECT i, v, divergence > 0 AND reach <= 0.1 * all_items AS differs FROM (SELECT *, count(*) OVER (ORDER BY divergence DESC) AS reach, count(*) OVER () AS all_items FROM apart)),
k AS (SELECT *, row_number() OVER (PARTITION BY model_name, category ORDER BY draw, id, run_id, input_variant) AS place, row_number() OVER (PARTITION BY model_name, input_variant ORDER BY draw, id, run_id) AS noisy FROM d JOIN low ON m = model_name LEFT JOIN texts ON i = id AND v = input_variant),
w AS (SELECT model_name, run_id, id, input_variant, category, concat_ws(';', CASE WHEN {CRIT} THEN 'failed' END, CASE WHEN protected_tokens_pass = 'false' THEN 'protected_tokens' END, CASE WHEN input_variant = 'ocr_noise' AND noisy <= 40 THEN 'ocr_noise' END, CASE WHEN comet_score <= bound THEN 'low_score' END, CASE WHEN place <= 10 THEN 'random' END, CASE WHEN differs THEN 'models_differ' END) AS reasons FROM k)
SELECT * FROM w WHERE reasons <> ''""")
def review_sample(spark, sf_dir):
    return sampling.review_sample(facts(spark, sf_dir))


@query("blinded_sample", f"{cte('facts')} SELECT substr(sha256(model_name || 'salt'), 1, 12) AS blind_id, run_id, id, input_variant, translation_ja FROM facts WHERE {CRIT}")
def blinded_sample(spark, sf_dir):
    f = typed(facts(spark, sf_dir)).where("f_critical").select("model_name", "run_id", "id", "input_variant", "translation_ja")
    return sampling.blind(f, "salt")


@query("sorted_facts", f"{cte('facts')} SELECT event_id, model_name || '|' || run_id || '|' || id || '|' || input_variant AS key_string, trim(translation_ja) AS said FROM facts")
def sorted_facts(spark, sf_dir):
    return facts(spark, sf_dir).select("event_id", key_text(*KEY).alias("key_string"), trimmed("translation_ja").alias("said")).orderBy("key_string")


from . import selection, trees  # noqa: E402, F401  they register their queries
