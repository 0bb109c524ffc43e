"""Named queries about choosing: items for review, models to prefer, runs to repeat, intervals of scores; with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgauge.operators import divergence, inputs, invalid_runs, ranks, sampling, skyline, summaries
from lexgauge.operators.facts import typed

from .registry import GEN, LAT, LOOSE, MEAN_DISTANCE, OK, QUALIFICATION_SQL, facts, query, r4, rounded
from .views import cte, view

APART = f"""{cte('answers')}, x0 AS (SELECT id, input_variant, model_name, min(translation_ja) AS t FROM answers GROUP BY ALL),
apart AS (SELECT x.id, x.input_variant, {MEAN_DISTANCE} AS divergence, max(coalesce(levenshtein(x.t, y.t)::double / nullif(greatest(octet_length(encode(x.t)), octet_length(encode(y.t))), 0), 0.0)) AS widest, count(*) AS pairs
  FROM x0 x JOIN x0 y ON x.id = y.id AND x.input_variant = y.input_variant AND x.model_name < y.model_name GROUP BY ALL)"""


@query("item_divergence", f"{APART} SELECT id, input_variant, 4 AS model_count, {r4('divergence', 'divergence')}, {r4('widest', 'widest')} FROM apart WHERE pairs = 6")
def item_divergence(spark, sf_dir):
    return rounded(divergence.item_divergence(view(spark, sf_dir, "answers"), unit="bytes"))


@query("divergent_items", f"""{APART}, r AS (SELECT *, count(*) OVER (ORDER BY divergence DESC) AS reach, count(*) OVER () AS all_items FROM apart)
SELECT id, input_variant, {r4('divergence', 'divergence')} FROM r WHERE divergence > 0 AND reach <= 0.1 * all_items""")
def divergent_items(spark, sf_dir):
    """A tenth of the items at most."""
    return rounded(divergence.strongly_divergent(view(spark, sf_dir, "answers"), unit="bytes").select("id", "input_variant", "divergence"))


def beats(a: str, b: str, high: list[str], low: list[str]) -> str:
    """SQL: a dominates b; nulls are worse than any value."""
    cells = [(f"coalesce({a}.{c}, -1e308)", f"coalesce({b}.{c}, -1e308)") for c in high] + [(f"-coalesce({a}.{c}, 1e308)", f"-coalesce({b}.{c}, 1e308)") for c in low]
    return " AND ".join(f"{x} >= {y}" for x, y in cells) + " AND (" + " OR ".join(f"{x} > {y}" for x, y in cells) + ")"


HIGH, LOW = ["comet_mean", "sentence_chrf_mean", "human_usability_pass_rate", "generation_tps_mean"], ["ocr_comet_drop", "latency_p50_ms", "latency_p95_ms"]


@query("tradeoff_models", f"""{cte('facts')}, gate AS (SELECT model_name, qualification_status FROM ({QUALIFICATION_SQL})),
s AS (SELECT model_name, {r4(f"avg({GEN})", "generation_tps_mean")}, {r4(f"quantile_cont({LAT}, 0.5)", "latency_p50_ms")}, {r4(f"quantile_cont({LAT}, 0.95)", "latency_p95_ms")} FROM facts GROUP BY model_name),
a AS (SELECT model_name, {r4("avg(comet_score)", "comet_mean")}, {r4("avg(chrf_score)", "sentence_chrf_mean")}, {r4("avg(CASE human_usability_pass WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END)", "human_usability_pass_rate")} FROM facts WHERE run_id = '1' GROUP BY model_name),
o AS (SELECT c.model_name, {r4("avg(c.comet_score) - avg(n.comet_score)", "ocr_comet_drop")} FROM facts c JOIN facts n ON c.model_name = n.model_name AND c.run_id = n.run_id AND c.id = n.id AND c.input_variant = 'ocr_clean' AND n.input_variant = 'ocr_noise' GROUP BY c.model_name),
m AS (SELECT s.*, comet_mean, sentence_chrf_mean, human_usability_pass_rate, ocr_comet_drop FROM s JOIN a ON a.model_name = s.model_name JOIN gate ON gate.model_name = s.model_name LEFT JOIN o ON o.model_name = s.model_name WHERE qualification_status = 'PASS')
SELECT model_name, {', '.join(HIGH + LOW)} FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE {beats('b', 'm', HIGH, LOW)})""")
def tradeoff_models(spark, sf_dir):
    """Models that pass the gates and that no other such model beats in quality, speed and resistance to noise."""
    f = typed(facts(spark, sf_dir))
    drops = summaries.noise_summary(f).select(F.col("model_name").alias("__m"), F.col("comet_drop").alias("ocr_comet_drop"))
    models = summaries.model_summary(f, thresholds=LOOSE).join(drops, F.col("model_name") == F.col("__m"), "left")
    gated = rounded(models.where("qualification_status = 'PASS'").select("model_name", *HIGH, *LOW))
    return skyline.skyline(gated, HIGH, LOW)


REQUEST_HIGH, REQUEST_LOW = ["comet_score", "chrf_score", "generation_tokens_per_second"], ["total_latency_ms"]


@query("tradeoff_requests", f"""{cte('facts')} SELECT event_id, model_name, {', '.join(REQUEST_HIGH)}, {r4('total_latency_ms', 'total_latency_ms')} FROM facts WHERE {OK} AND NOT EXISTS (SELECT 1 FROM facts b WHERE b.{OK} AND {beats('b', 'facts', REQUEST_HIGH, REQUEST_LOW)})""")
def tradeoff_requests(spark, sf_dir):
    """Successful requests that no other one beats in both scores, speed and latency; a third of the scores are null and many equal."""
    f = facts(spark, sf_dir).where("request_success = 'true'").select("event_id", "model_name", *REQUEST_HIGH, *REQUEST_LOW)
    best = skyline.skyline(f, REQUEST_HIGH, REQUEST_LOW)
    return best.withColumn("total_latency_ms", F.round("total_latency_ms", 4) + F.lit(0.0))


RUN_KEYS = "model_name, run_id, input_variant"


def differs_sql(rule: str, columns: list[str]) -> str:
    digest = f"md5(concat_ws('|', {', '.join(columns)}))"
    names = ", ".join(f"CASE WHEN max(CASE WHEN k.{c} <> u.{c} THEN 1 ELSE 0 END) = 1 THEN '{c}' END" for c in columns)
    usual = f"SELECT * FROM (SELECT input_variant, {', '.join(columns)}, row_number() OVER (PARTITION BY input_variant ORDER BY count(*) DESC, {digest}) AS place FROM runs GROUP BY input_variant, {', '.join(columns)}) WHERE place = 1"
    odd = " OR ".join(f"k.{c} <> u.{c}" for c in columns)
    return f"SELECT '{rule}' AS rule, k.model_name, k.run_id, k.input_variant, count(*) AS amount, concat_ws(';', {names}) AS detail FROM runs k JOIN ({usual}) u ON u.input_variant = k.input_variant WHERE {odd} GROUP BY k.model_name, k.run_id, k.input_variant"


RUN_SETTINGS = ["temperature", "top_p", "seed", "max_tokens"]


@query("invalid_runs", f"""{cte('runs')}, r AS (SELECT {RUN_KEYS}, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (NOT ({OK})) AS failed FROM runs GROUP BY {RUN_KEYS}),
e AS (SELECT input_variant, count(DISTINCT id) AS expected FROM runs GROUP BY input_variant),
o AS (SELECT r.*, sum(n) OVER (PARTITION BY model_name, input_variant) - n AS rest_n, sum(failed) OVER (PARTITION BY model_name, input_variant) - failed AS rest_failed FROM r),
p AS (SELECT *, (rest_failed + 0.5)::double / (rest_n + 1) AS p FROM o WHERE rest_n > 0)
SELECT 'missing_items' AS rule, r.model_name, r.run_id, r.input_variant, expected - ids AS amount, '' AS detail FROM r JOIN e ON e.input_variant = r.input_variant WHERE ids < expected
UNION ALL SELECT 'duplicate_keys', {RUN_KEYS}, n - ids, '' FROM r WHERE n > ids
UNION ALL SELECT 'failure_outlier', {RUN_KEYS}, failed, '' FROM p WHERE failed - n * p > 3 * sqrt(n * p * (1 - p))
UNION ALL {differs_sql('settings_differ', RUN_SETTINGS)}
UNION ALL {differs_sql('prompt_differs', ['system_prompt_hash'])}""")
def invalid_run_findings(spark, sf_dir):
    return invalid_runs.invalid_runs(view(spark, sf_dir, "runs"), settings=RUN_SETTINGS)


@query("permuted_items", f"{cte('pairs')} SELECT row_number() OVER () AS execution_index FROM pairs")
def permuted_items(spark, sf_dir):
    """Each number from 1 to the count of items comes once."""
    return inputs.permuted(view(spark, sf_dir, "pairs").select("id"), 42, "id").select("execution_index")


Q = {"p50": 0.5, "p95": 0.95}
QUANTILES = ", ".join(r4(f"quantile_cont({{x}}, {p})", n) for n, p in Q.items())


@query("price_percentiles", f"SELECT l_returnflag, l_linestatus, {QUANTILES.format(x='l_extendedprice')} FROM lineitem GROUP BY l_returnflag, l_linestatus")
def price_percentiles(spark, sf_dir):
    """Exact percentiles of groups whose values no task holds."""
    return rounded(ranks.percentiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_extendedprice", Q, keep=1000))


@query("latency_percentiles", f"{cte('facts')} SELECT model_name, {QUANTILES.format(x=LAT)} FROM facts GROUP BY model_name")
def latency_percentiles(spark, sf_dir):
    f = typed(facts(spark, sf_dir))
    return rounded(ranks.percentiles(f.withColumn("latency", F.when(F.col("f_success"), F.col("f_latency"))), ["model_name"], "latency", Q))


WEIGHT = "(" + " + ".join(f"CASE WHEN drawn >= '{b}' THEN 1 ELSE 0 END" for b in sampling.weight_bounds()) + ")"
REPLICATES = f"""{cte('facts')}, v AS (SELECT model_name, id, comet_score AS x FROM facts WHERE input_variant = 'standard' AND run_id = '1' AND comet_score IS NOT NULL),
r AS (SELECT unnest(generate_series(1, 1000)) AS replicate)"""


@query("bootstrap_interval", f"""{REPLICATES}, w AS (SELECT model_name, replicate, x, {WEIGHT} AS w FROM (SELECT *, substr(md5(id || '|' || cast(replicate as varchar) || '|12345'), 1, 8) AS drawn FROM v CROSS JOIN r)),
m AS (SELECT model_name, replicate, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) END AS m FROM w GROUP BY ALL),
b AS (SELECT model_name, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY model_name)
SELECT v.model_name, {r4('avg(x)', 'mean')}, {r4('min(low)', 'low')}, {r4('min(high)', 'high')} FROM v JOIN b ON b.model_name = v.model_name GROUP BY v.model_name""")
def bootstrap_interval(spark, sf_dir):
    f = typed(facts(spark, sf_dir)).where("input_variant = 'standard' AND run_id = '1'")
    return rounded(sampling.bootstrap(f, ["model_name"], "f_comet"))


@query("paired_significance", f"""{REPLICATES}, p AS (SELECT * FROM (SELECT id, avg(CASE WHEN model_name = 'model-0' THEN x END) AS a, avg(CASE WHEN model_name = 'model-1' THEN x END) AS b FROM v GROUP BY id) WHERE a IS NOT NULL AND b IS NOT NULL),
w AS (SELECT replicate, a - b AS x, {WEIGHT} AS w FROM (SELECT *, substr(md5(id || '|' || cast(replicate as varchar) || '|12345'), 1, 8) AS drawn FROM p CROSS JOIN r)),
d AS (SELECT replicate, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) END AS d FROM w GROUP BY replicate), c AS (SELECT avg(d) AS mid FROM d), o AS (SELECT avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS difference FROM p)
SELECT {r4('min(mean_a)', 'mean_a')}, {r4('min(mean_b)', 'mean_b')}, {r4('min(difference)', 'difference')}, {r4('(count(*) FILTER (abs(d - mid) >= abs(difference)) + 1) / (count(*) + 1)', 'p_value')} FROM d, c, o""")
def paired_significance(spark, sf_dir):
    f = typed(facts(spark, sf_dir)).where("input_variant = 'standard' AND run_id = '1'")
    return rounded(sampling.paired_p_value(f, "f_comet", "model-0", "model-1"))
