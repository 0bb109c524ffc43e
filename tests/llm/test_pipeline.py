from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm import WORD, brute_components, check_pieces, library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_stages_keep_the_columns(spark, docs, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, none, docs.withColumn("score", F.lit(1)).withColumn("component_id", F.lit("x"))):
            out = stage(spark, df, SF)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= df.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_near_duplicates_leave_one_of_each_group(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted({c for _, c in brute_components(rows, 5, 80, 100).values()})
    doubled = docs.unionByName(docs.limit(5))
    got = corpus_pipeline.drop_near_duplicates(spark, doubled, SF).collect()
    assert sorted(r.doc_id for r in got) == want


def test_near_duplicates_and_ids(spark):
    """Shared ids, rows without an id, null and empty texts: each row's fate."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, one), (3, two), (1, one + " x"), (4, two + " y"), (3, one), (5, None), (5, None), (6, ""), (7, ""), (None, one), (None, one), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect())
    assert got == Counter([(1, one + " x"), (3, two), (5, None), (6, ""), (7, ""), (None, one), (None, one), (None, None)])


def test_toxic_stage_against_the_model(spark, docs):
    """The stage keeps the rows that the model, called text by text, scores under 0.5."""
    from lexgauge.llm import toxicity

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    more = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    want = sorted((r.doc_id, r.text or "") for r in more.collect() if model.score(r.text or "") < 0.5)
    assert sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_toxic(spark, more, SF).collect()) == want


def test_lines_stage_keeps_clean_documents(spark):
    common = "this very line of words is found in many of the texts"
    rows = [(i, f"text {chr(97 + i)}{chr(98 + i)} alone has this line of words\n{common}", "en", "s", 1) for i in range(5)] + [(9, common, "en", "s", 1), (10, "", "en", "s", 0), (11, None, "en", "s", None)]
    got = {r.doc_id: r for r in corpus_pipeline.drop_template_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 10, 11}
    assert got[0].text == rows[0][1] and "\n" not in got[1].text and got[1].n_chars == len(got[1].text)


def test_whole_run(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) <= docs.count()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    encode = library(WORD)
    check_pieces(rows, [(r.doc_id, [*encode(r.text), 1]) for r in kept.collect()])
