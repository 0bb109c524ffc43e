"""Named queries read whole texts: what stands far into a text counts."""

import re
import unicodedata

import pytest

from lexgauge.plans.registry import QUERIES
from lexgauge.plans.views import view


def documents(spark, path, texts):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def conversations(spark, path, turns):
    """``turns`` are pairs of a user's text and the answer, one conversation each."""
    rows = [(i, k, ("user", "assistant")[k], t) for i, two in enumerate(turns) for k, t in enumerate(two)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """One text for each mark that the view puts in; a fence, an opening phrase and a closing quote stand at its end."""
    text = "word " * 300 + '\n```\ncode\n```\nHere is the translation : end"'
    return text, documents(spark, tmp_path_factory.mktemp("late"), [text] * 9)


def test_marks_leave_the_text_whole(spark, late):
    text, sf = late
    assert {r.markdown_detected for r in QUERIES["markdown"](spark, sf).collect()} == {True}
    assert "" not in {r.pattern for r in QUERIES["extra_text"](spark, sf).collect()}
    assert [r.doc_id for r in QUERIES["quotes"](spark, sf).collect() if r.unnecessary_quotes] == [3]
    assert min(r.output_length for r in QUERIES["excessive_length"](spark, sf).collect()) >= len(text)


def brute_longest(a, b):
    a, b = a.lower(), b.lower()
    return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)


def test_longest_match_far_into_the_texts(spark, tmp_path):
    passage = "this sentence Is copied from far within the source and is longer than sixty characters"
    turns = [("q" * 70 + passage, "z" * 70 + passage.upper() + "y"), ("abc", "xbcx"), ("k" * 65 + "tail", "tail"), ("", "a")]
    got = {r.id: r.longest_source_match for r in QUERIES["longest_source_match"](spark, conversations(spark, tmp_path, turns)).collect()}
    assert got == {f"{i}-0": brute_longest(a, b) for i, (a, b) in enumerate(turns)} and got["0-0"] == len(passage)


def test_pairs_are_whole_turns(spark, tmp_path):
    source, answer = "alpha " * 60 + "omega", "beta " * 60 + "psi"
    sf = conversations(spark, tmp_path, [(source, answer)] * 3)
    p = view(spark, sf, "pairs").collect()
    assert {(r.source_en, r.context_ja, r.clean_source_en, r.translation_ja) for r in p} == {(source, source, source, answer)}
    assert {r.reference_ja for r in p} == {answer.replace("beta", "alpha")}
    assert all(r.input_text.endswith(source) for r in QUERIES["prompt_text"](spark, sf).collect())


def test_normalize_covers_all_rows(spark, tmp_path):
    texts = ["plain text", "\u201ccurly\u201d \u2014 dash", "no\u00a0break", "Ａ１％ ﾊﾟ ①", "日本語", "e\u0301 \ufb01 x\u00b2", "", None]
    got = {r.doc_id: r.normalized for r in QUERIES["normalize_text"](spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {i: re.sub(r"[ \t\f\v]+", " ", unicodedata.normalize("NFKC", t or "").strip()) for i, t in enumerate(texts)}
