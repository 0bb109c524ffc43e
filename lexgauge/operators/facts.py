"""Typed columns over joined result rows: what a request's outcome counts as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.values import as_bool, number_of, text, trimmed

# Names under which score files carry a metric, the first numeric one counts.
COMET_NAMES = ["comet_score", "comet", "score"]
CHRF_NAMES = ["chrf_score", "sentence_chrf", "chrf"]
CORPUS_CHRF_NAMES = ["chrf_corpus", "corpus_chrf"]
ACCURACY_NAMES = ["human_accuracy", "accuracy", "human_accuracy_score"]
FLUENCY_NAMES = ["human_fluency", "fluency", "human_fluency_score"]
USABILITY_NAMES = ["human_usability_pass", "human_usability", "usability_pass", "pass"]
FORMAT_FLAGS = ["extra_text_detected", "markdown_detected", "unnecessary_quotes", "excessive_length"]

#: Typed twins that ``typed`` adds.
TYPED = "f_success f_timeout f_empty f_format f_critical f_status f_latency f_prompt_tps f_gen_tps f_comet f_chrf f_chrf_corpus f_protected f_required f_accuracy f_fluency f_usable".split()


def typed(facts: DataFrame) -> DataFrame:
    """Add the typed twins; absent columns count as blank cells."""
    has = set(facts.columns)
    cell = lambda c: text(c) if c in has else F.lit("")
    flag = lambda c: as_bool(cell(c)) if c in has else F.lit(None).cast("boolean")
    number = lambda names: F.coalesce(*[number_of(facts, c) for c in names if c in has], F.lit(None).cast("double"))
    success = F.coalesce(flag("request_success"), F.lit(False))
    empty = F.coalesce(flag("empty_output"), trimmed(cell("translation_ja")) == "")
    marks = F.lit(False)
    for c in FORMAT_FLAGS:
        marks = marks | F.coalesce(flag(c), F.lit(False))
    status = F.upper(cell("rule_check_status"))
    return facts.withColumns({
        "f_success": success,
        "f_timeout": F.contains(F.lower(F.concat_ws(";", cell("request_error_type"), cell("error_type"), cell("error"))), F.lit("timeout")),
        "f_empty": empty,
        "f_format": ~marks,
        "f_critical": ~success | empty | (status == "FAIL"),
        "f_status": status,
        "f_latency": number(["total_latency_ms"]),
        "f_prompt_tps": number(["prompt_tokens_per_second"]),
        "f_gen_tps": number(["generation_tokens_per_second"]),
        "f_comet": number(COMET_NAMES),
        "f_chrf": number(CHRF_NAMES),
        "f_chrf_corpus": number(CORPUS_CHRF_NAMES),
        "f_protected": flag("protected_tokens_pass"),
        "f_required": flag("required_terms_pass"),
        "f_accuracy": number(ACCURACY_NAMES),
        "f_fluency": number(FLUENCY_NAMES),
        "f_usable": F.coalesce(*[flag(c) for c in USABILITY_NAMES if c in has], F.lit(None).cast("boolean")),
    })


def ensure_typed(facts: DataFrame) -> DataFrame:
    return facts if "f_success" in facts.columns else typed(facts)


def optional(facts: DataFrame, c: str) -> Column:
    return text(c) if c in facts.columns else F.lit("")
