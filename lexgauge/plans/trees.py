"""Named queries that read what they wrote: result trees of CSV files, stored answers, exported files; with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.functions.values import KEY, as_float
from lexgauge.operators import quality, responses
from lexgauge.operators.cut import new_folder
from lexgauge.sinks import reports
from lexgauge.sources import completion_source
from lexgauge.sources.result_tree import Tree, load_tree, read_csv

from .registry import facts, query, r4, rounded
from .views import cte, view


def write_bundles(tables: dict[str, DataFrame], root: str, bundle: str = "bundle") -> None:
    """Each table as CSV files ``<root>/<bundle>/<label>/*<suffix>``; a key is the label and the suffix, joined by a blank."""
    for name, df in tables.items():
        label, suffix = name.split()
        spark = df.sparkSession
        at = f"{root}/_{label}"
        df.write.partitionBy(bundle).option("header", True).option("escape", '"').csv(at)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in fs.listStatus(path(at)):
            if not folder.isDirectory():
                continue
            to = f"{root}/{folder.getPath().getName().split('=', 1)[1]}/{label}"
            fs.mkdirs(path(to))
            for f in fs.listStatus(folder.getPath()):
                fs.rename(f.getPath(), path(f"{to}/{f.getPath().getName().removesuffix('.csv')}{suffix}"))
        fs.delete(path(at), True)


def tree(spark: SparkSession, sf_dir: str) -> Tree:
    """The facts written as a tree of four bundles and read back: raw and rule files that lack rows, two kinds of score files of other headers, one over the other."""
    f = facts(spark, sf_dir)
    e = F.col("event_id")
    raw = f.where(e % 10 != 3).select(*KEY, "bundle", "request_success", (F.col("total_latency_ms") - 1).alias("total_latency_ms"), "category", "event_id")
    rule = f.where(e % 10 != 7).select(*KEY, "bundle", F.when(e % 4 == 0, "false").otherwise(F.col("request_success")).alias("request_success"), "rule_check_status", F.when(e % 5 == 0, "").otherwise(F.col("category")).alias("category"))
    comet = f.where("comet_score is not null").select(*KEY, "bundle", F.col("comet_score").alias("score"))
    again = f.where("comet_score is not null and event_id % 6 = 0").select(*KEY, "bundle", (F.col("comet_score") + 1).alias("COMET"), F.lit("seen").alias("note"))
    chrf = f.where(e % 3 == 1).select(*KEY, "bundle", F.coalesce(F.col("chrf_score").cast("string"), F.lit("n/a")).alias("sentence_chrf"))
    root = new_folder(spark, "result-tree")
    write_bundles({"a _raw_results.csv": raw, "b _rule_evaluation.csv": rule, "c _comet_scores.csv": comet, "d _comet_scores.csv": again, "e _chrf_scores.csv": chrf}, root)
    return load_tree(spark, root)


@query("tree_facts", f"""{cte('facts')} SELECT model_name, run_id, id, input_variant, bundle,
  CASE WHEN event_id % 10 = 7 THEN request_success WHEN event_id % 4 = 0 THEN 'false' ELSE request_success END AS request_success,
  CASE WHEN event_id % 10 = 7 THEN category WHEN event_id % 5 = 0 THEN '' ELSE category END AS category,
  CASE WHEN event_id % 10 <> 7 THEN rule_check_status END AS rule_check_status, CASE WHEN event_id % 10 <> 3 THEN event_id END AS event_id,
  {r4('CASE WHEN event_id % 6 = 0 THEN comet_score + 1 ELSE comet_score END', 'comet_score')}, {r4('CASE WHEN event_id % 3 = 1 THEN chrf_score END', 'chrf_score')}, CASE WHEN event_id % 6 = 0 AND comet_score IS NOT NULL THEN 'seen' END AS note FROM facts""")
def tree_facts(spark, sf_dir):
    t = tree(spark, sf_dir).facts
    return rounded(t.select(*KEY, "bundle", "request_success", "category", "rule_check_status", F.col("event_id").try_cast("long").alias("event_id"), as_float("comet_score").alias("comet_score"), as_float("chrf_score").alias("chrf_score"), "note"))


@query("tree_findings", f"""{cte('facts')}, items AS (SELECT DISTINCT bundle, id, input_variant FROM facts), base AS (SELECT * FROM items WHERE bundle = 'model-0'),
sets AS (SELECT items.bundle, count(*) AS n, count(base.id) AS shared FROM items LEFT JOIN base ON base.id = items.id AND base.input_variant = items.input_variant WHERE items.bundle <> 'model-0' GROUP BY items.bundle), total AS (SELECT count(*) AS t FROM base),
found AS (SELECT 'ERROR' AS severity, model_name, 'raw row has no matching rule_evaluation row' AS issue FROM facts WHERE event_id % 10 = 7
  UNION ALL SELECT 'ERROR', model_name, 'rule_evaluation row has no matching raw row' FROM facts WHERE event_id % 10 = 3
  UNION ALL SELECT 'WARNING', model_name, 'COMET score outside expected range' FROM facts WHERE event_id % 6 = 0 AND comet_score + 1 > 1.5
  UNION ALL SELECT 'WARNING', model_name, 'negative latency' FROM facts WHERE event_id % 10 <> 3 AND total_latency_ms - 1 < 0
  UNION ALL SELECT 'WARNING', bundle, 'missing ' || cast(t - shared as varchar) || ' items compared with model-0' FROM sets, total WHERE t > shared
  UNION ALL SELECT 'WARNING', bundle, 'extra ' || cast(n - shared as varchar) || ' items compared with model-0' FROM sets WHERE n > shared)
SELECT severity, model_name, issue, count(*) AS finding_count FROM found GROUP BY ALL""")
def tree_findings(spark, sf_dir):
    return tree(spark, sf_dir).findings.groupBy("severity", "model_name", "issue").agg(F.count("*").alias("finding_count"))


@query("stored_answers", f"""{cte('pairs')} SELECT id, conv_id % 9 <> 4 AS request_success, CASE conv_id % 9 WHEN 4 THEN '' ELSE regexp_replace(translation_ja, '^\\s+|\\s+$', '', 'g') END AS translation_ja, CASE conv_id % 9 WHEN 4 THEN 'missing_field' ELSE '' END AS error_type, CASE WHEN conv_id % 9 <> 4 THEN length(translation_ja) END AS completion_tokens FROM pairs""")
def stored_answers(spark, sf_dir):
    """Bodies written by Spark, read through the data source of completions by several callers, and judged."""
    p = view(spark, sf_dir, "pairs")
    message = F.array(F.struct(F.struct(F.col("translation_ja").alias("content")).alias("message")))
    body = F.to_json(F.struct(message.alias("choices"), F.struct(F.length("translation_ja").alias("completion_tokens")).alias("usage")))
    at = new_folder(spark, "stored-answers")
    p.select("id", F.when(F.col("conv_id") % 9 == 4, '{"choices":[]}').otherwise(body).alias("raw_response")).write.parquet(at)
    completion_source.register(spark)
    df = responses.judged(spark.read.format("completions").option("stored", at).option("callers", 4).load())
    return df.select("id", "request_success", "translation_ja", "error_type", F.col("completion_tokens").cast("long").alias("completion_tokens"))


@query("exported_failures", f"{cte('facts')} SELECT event_id AS at, model_name, id, run_id, translation_ja, rule_check_status, row_number() OVER (ORDER BY event_id) AS record_no FROM facts WHERE rule_check_status <> 'PASS'")
def exported_failures(spark, sf_dir):
    """Rows written by tasks into one file, in the table's order, and read back with their places in the file."""
    f = facts(spark, sf_dir).where("rule_check_status <> 'PASS'").select(F.col("event_id").alias("at"), "model_name", "id", "run_id", "translation_ja", "rule_check_status")
    at = f"{new_folder(spark, 'export')}/failures.csv"
    reports.export_csv(f.orderBy("at"), at)
    back = read_csv(spark, at).drop("file")
    return back.select(F.col("at").cast("long").alias("at"), "model_name", "id", "run_id", "translation_ja", "rule_check_status", "record_no")


@query("category_corpora", f"""{cte('pairs')} SELECT 'source_en' AS corpus, category, trim(regexp_replace(source_en, '\r\n|\n|\r', ' ', 'g')) AS line FROM pairs UNION ALL SELECT 'translation_ja', category, trim(regexp_replace(translation_ja, '\r\n|\n|\r', ' ', 'g')) FROM pairs""")
def category_corpora(spark, sf_dir):
    """Corpora by category, written in one job a column and read back."""
    at = new_folder(spark, "corpora")
    reports.write_corpora(view(spark, sf_dir, "pairs"), at, ["source_en", "translation_ja"])
    back = [spark.read.text(f"{at}/{c}").select(F.lit(c).alias("corpus"), "category", F.col("value").alias("line")) for c in ("source_en", "translation_ja")]
    return back[0].unionByName(back[1])


@query("corpus_alignment", f"""{cte('pairs')}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS n, source_en AS t FROM pairs), b AS (SELECT id, row_number() OVER (ORDER BY id) AS n, CASE WHEN conv_id % 11 = 0 THEN ' ' ELSE translation_ja END AS t FROM pairs WHERE conv_id % 10 <> 3)
SELECT count(*) FILTER (b.id IS NULL) AS only_left, count(*) FILTER (a.id IS NULL) AS only_right, count(*) FILTER (a.n <> b.n) AS moved, count(*) FILTER (trim(a.t) = '' OR trim(b.t) = '') AS blank FROM a FULL JOIN b ON a.id = b.id""")
def corpus_alignment(spark, sf_dir):
    """Two exported corpora, one of which lacks lines and has blank ones."""
    p = view(spark, sf_dir, "pairs")
    left = reports.corpus_lines(p, "source_en")
    right = reports.corpus_lines(p.where("conv_id % 10 <> 3").withColumn("said", F.when(F.col("conv_id") % 11 == 0, " ").otherwise(F.col("translation_ja"))), "said")
    return quality.alignment(left, right, text_col="line")
