"""Deterministic result tables derived from the star-schema tables, in Spark and in SQL.

``dialect`` fills the few places where the two engines write the same thing
differently; all else of each view is one text for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"idiv": lambda a, b: f"({a} div {b})", "k": "cast(get_json_object(props, '$.k') as int)", "text": "string"}
DUCK = {"idiv": lambda a, b: f"({a} // {b})", "k": "cast(json_extract_string(props, '$.k') as int)", "text": "varchar"}

def facts_sql(d: dict) -> str:
    i = d["idiv"]
    t = d["text"]
    return f"""
SELECT e.event_id,
  'model-' || cast({i('e.event_id', 9)} % 4 as {t}) AS model_name,
  'model-' || cast({i('e.event_id', 9)} % 4 as {t}) AS bundle,
  cast(e.event_id % 3 + 1 as {t}) AS run_id,
  'IT' || cast({i('e.event_id', 36)} as {t}) AS id,
  CASE {i('e.event_id', 3)} % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'ocr_clean' ELSE CASE {i('e.event_id', 36)} % 10 WHEN 4 THEN 'context' ELSE 'ocr_noise' END END AS input_variant,
  'category-' || cast({i('e.event_id', 36)} % 6 as {t}) AS category,
  'sub-' || cast({i('e.event_id', 36)} % 5 as {t}) AS subcategory,
  CASE {i('e.event_id', 36)} % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN e.event_type = 'error' THEN 'false' ELSE 'true' END AS request_success,
  CASE WHEN e.event_type = 'error' AND k % 4 = 0 THEN 'timeout' WHEN e.event_type = 'error' THEN 'http' ELSE '' END AS error_type,
  e.value AS total_latency_ms,
  cast(k as double) AS generation_tokens_per_second,
  cast(k * 2 as double) AS prompt_tokens_per_second,
  CASE WHEN k % 29 = 0 THEN '' WHEN {i('e.event_id', 36)} % 3 = 0 THEN e.event_type ELSE 'said ' || cast({i('e.event_id', 36)} as {t}) END AS translation_ja,
  CASE WHEN k % 10 < 7 THEN 'PASS' WHEN k % 10 < 9 THEN 'WARN' ELSE 'FAIL' END AS rule_check_status,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 7 = 0 THEN 'false' ELSE 'true' END AS protected_tokens_pass,
  CASE WHEN k % 13 = 0 THEN '' WHEN k % 5 = 0 THEN 'false' ELSE 'true' END AS required_terms_pass,
  CASE WHEN k % 17 = 0 THEN 'true' ELSE 'false' END AS unnecessary_quotes,
  CASE WHEN k % 3 = 0 THEN NULL ELSE cast(k as double) / 128 END AS comet_score,
  CASE WHEN k % 4 = 0 THEN NULL ELSE cast(k as double) / 2 END AS chrf_score,
  CASE WHEN l.quality IS NULL THEN '' WHEN l.quality = 1 THEN 'true' ELSE 'false' END AS human_usability_pass,
  'weights-' || cast({i('e.event_id', 9)} % 4 as {t}) || '.bin' AS model_file
FROM (SELECT *, {d['k']} AS k FROM events) e LEFT JOIN labels l ON l.doc_id = e.event_id
"""


def pairs_sql(d: dict) -> str:
    """User turns as sources, the following assistant turns as outputs, with tokens and terms from leading words.

    All turns are whole; the reference is the output with its first word replaced by the source's.
    """
    t = d["text"]
    word = lambda c, n: f"split_part({c}, ' ', {n})"
    return f"""
SELECT u.conv_id, u.turn, cast(u.conv_id as {t}) || '-' || cast(u.turn as {t}) AS id,
  u.text AS source_en, a.text AS translation_ja,
  replace(a.text, {word('a.text', 1)}, {word('u.text', 1)}) AS reference_ja,
  {word('a.text', 1)} || CASE u.conv_id % 2 WHEN 0 THEN ';' || {word('u.text', 2)} || ';' || cast(u.conv_id % 20 as {t}) || ';' || {word('a.text', 1)} ELSE '' END AS protected_tokens,
  {word('u.text', 1)} || '=' || {word('a.text', 2)} || CASE u.conv_id % 4 WHEN 1 THEN '' ELSE ';' || {word('u.text', 2)} || '=' || {word('u.text', 3)} || ';none' END AS required_terms,
  CASE u.conv_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'terminology' ELSE 'context' END AS input_variant,
  CASE u.conv_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'odd' END AS difficulty,
  'category-' || cast(u.conv_id % 6 as {t}) AS category, 'sub-' || cast(u.conv_id % 5 as {t}) AS subcategory,
  u.text AS context_ja, u.text AS clean_source_en, '' AS evaluation_focus
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""


def marked_sql(d: dict) -> str:
    """Whole documents with marks put in by id, so that each check has hits."""
    return """
SELECT doc_id, n_chars,
  CASE doc_id % 9
    WHEN 0 THEN 'Translation: ' || text
    WHEN 1 THEN substr(text, 1, 50) || chr(10) || '## ' || substr(text, 51)
    WHEN 2 THEN '- ' || text
    WHEN 3 THEN '"' || text || '"'
    WHEN 4 THEN '**' || substr(text, 1, 30) || '** ' || substr(text, 31)
    WHEN 5 THEN substr(text, 1, 40) || chr(10) || 'Here is the translation : ' || substr(text, 41)
    WHEN 6 THEN '翻訳：' || text
    WHEN 7 THEN chr(10) || '12. ' || text
    ELSE text END AS body,
  substr(text, 1, cast(doc_id % 50 as int)) AS reference_ja
FROM documents
"""


def answers_sql(d: dict) -> str:
    """Four models' answers to each pair's item: the assistant's turn, the turn with another first word, the user's turn for a fifth, a turn without a letter for a third."""
    return f"""
SELECT p.id, p.category, p.input_variant, 'model-' || cast(m.k as {d['text']}) AS model_name, '1' AS run_id,
  CASE m.k WHEN 0 THEN p.translation_ja WHEN 1 THEN p.reference_ja
    WHEN 2 THEN CASE p.conv_id % 5 WHEN 0 THEN p.source_en ELSE p.translation_ja END
    ELSE CASE p.conv_id % 3 WHEN 0 THEN replace(p.translation_ja, 'e', '') ELSE p.translation_ja END END AS translation_ja
FROM ({pairs_sql(d)}) p CROSS JOIN (VALUES (0), (1), (2), (3)) AS m(k)
"""


def runs_sql(d: dict) -> str:
    """The facts with settings, and with runs that lack rows, repeat rows, fail often, or differ in settings or prompt."""
    return f"""
SELECT f.model_name, f.run_id, f.id, f.input_variant, f.total_latency_ms,
  CASE WHEN f.model_name = 'model-1' AND f.run_id = '2' AND f.event_id % 2 = 0 THEN 'false' ELSE f.request_success END AS request_success,
  CASE WHEN f.model_name = 'model-3' AND f.run_id = '2' AND f.event_id % 4 = 1 THEN '0.7' ELSE '0.0' END AS temperature,
  CASE WHEN f.model_name = 'model-3' AND f.run_id = '2' THEN '0.9' ELSE '1.0' END AS top_p, '42' AS seed, '256' AS max_tokens,
  CASE WHEN f.model_name = 'model-1' AND f.run_id = '3' AND f.input_variant = 'standard' THEN 'prompt-b' ELSE 'prompt-a' END AS system_prompt_hash
FROM ({facts_sql(d)}) f JOIN (VALUES (0), (1)) AS c(k) ON c.k = 0 OR f.model_name = 'model-0' AND f.run_id = '2' AND f.event_id % 7 = 0
WHERE NOT (f.model_name = 'model-2' AND f.run_id = '1' AND f.event_id % 5 = 0)
"""


VIEWS = {"answers": (answers_sql, ["conversations"]), "runs": (runs_sql, ["events", "labels"]), "facts": (facts_sql, ["events", "labels"]), "pairs": (pairs_sql, ["conversations"]), "marked": (marked_sql, ["documents"])}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of ``sf_dir``; table names are replaced by paths, so nothing is registered."""
    make, tables = VIEWS[name]
    sql = make(SPARK)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        for before in ("FROM", "JOIN"):
            sql = sql.replace(f"{before} {t}", f"{before} {{{t}}}")
    return spark.sql(sql, **frames)


def cte(*names: str) -> str:
    """``WITH`` clause of the views, for the SQL that checks a query."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][0](DUCK)})" for n in names)
