"""Deterministic checks of one generated text, as column expressions.

Only Unicode normalisation and the longest common substring need Python; both are
Arrow UDFs over whole columns.  All else stays in the JVM.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .values import bool_text, is_truthy, text, to_int, trimmed

# English terms that game texts keep.
ALLOWED_TERMS = ["HP", "MP", "SP", "XP", "DPS", "HUD", "UI", "HDR", "QTE", "FPS", "NPC", "DLC", "A", "B", "X", "Y", "L", "R", "LT", "RT", "LB", "RB", "Esc", "Enter", "Shift", "Ctrl", "Alt", "Tab", "Space", "WASD"]

# Openings that introduce a translation, tried in this order, case-insensitive, ^ at any line.
EXTRA_TEXT = [
    r"^\s*翻訳\s*[:：]",
    r"^\s*日本語訳\s*[:：]",
    r"以下が翻訳です",
    r"^\s*Translation\s*:",
    r"The Japanese translation is\s*:",
    r"Here is the translation\s*:",
]

# Markdown marks, ^ at any line.
MARKDOWN = [
    r"```",
    r"(?m)^\s{0,3}#{1,6}\s+\S",
    r"(?m)^\s{0,3}[-*+]\s+\S",
    r"(?m)^\s{0,3}\d+\.\s+\S",
    r"(?m)^\s{0,3}>\s+\S",
    r"(\*\*|__)[^*_]+(\*\*|__)",
]

# Quotes that may wrap a whole text.
QUOTES = [("「", "」"), ("『", "』"), ('"', '"'), ("'", "'")]

# Fixed value: placeholders in a source text.
PLACEHOLDER = r"\{[^}]+\}|%[A-Za-z0-9_]+%?|<[A-Za-z0-9_/.-]+>"

#: Java flags under which these patterns match as the checks mean them: Unicode classes, only \n ends a line.
FLAGS, FLAGS_NO_CASE = "(?dU)", "(?imdU)"
NUMERIC = r"^[0-9]+(\.[0-9]+)?%?$"
# The columns that the rules add, in order.
RULE_COLUMNS = [
    "request_success", "request_error_type", "protected_tokens_pass", "protected_token_expected_count", "protected_token_matched_count", "missing_protected_tokens", "required_terms_pass", "missing_required_terms", "empty_output", "extra_text_detected", "extra_text_pattern", "markdown_detected", "unnecessary_quotes", "english_residue_detected", "english_character_ratio", "longest_source_match", "excessive_length", "output_length", "reference_length", "output_length_ratio", "rule_check_status", "failure_reasons", "warning_reasons",
]


# The settings' names and defaults.
@dataclass(frozen=True)
class RuleConfig:
    max_reference_length_ratio: float = 4.0
    minimum_excessive_length: int = 80
    english_ratio_warning: float = 0.35
    english_word_warning_count: int = 4
    longest_source_match_warning: int = 20
    max_tokens_finish_reasons: list[str] = field(default_factory=lambda: ["length", "max_tokens"])
    allowed_english_terms: list[str] = field(default_factory=lambda: list(ALLOWED_TERMS))
    strict_terms: bool = False
    allow_quotes: bool = False

    @classmethod
    def from_json(cls, data: str, **more) -> RuleConfig:
        """Defaults overlaid by a JSON object; lists are replaced whole, unknown keys ignored."""
        given = json.loads(data)
        if not isinstance(given, dict):
            raise ValueError("config must be a JSON object")
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known} | more)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(c: Column | str) -> Column:
    """NFKC, one kind of line end, trimmed, runs of blanks within a line as one space."""
    return squeeze(_nfkc(text(c)))


def squeeze(c: Column | str) -> Column:
    """``normalize_text`` of a text that is NFKC already."""
    return F.regexp_replace(trimmed(F.regexp_replace(text(c), r"\r\n?", "\n")), r"[ \t\f\x0B]+", " ")


def split_semicolon(c: Column) -> Column:
    """The parts of a packed cell, each squeezed, blank ones left out."""
    return F.filter(F.transform(F.split(c, ";"), squeeze), lambda p: p != "")


@F.pandas_udf(ArrayType(StringType()))
def split_raw(s: pd.Series) -> pd.Series:
    """A raw packed cell cut at ASCII semicolons, each part under NFKC: a full-width semicolon does not cut."""
    return s.map(lambda t: [unicodedata.normalize("NFKC", p) for p in (t or "").split(";")])


def tokens_of(c: Column | str) -> Column:
    """The packed cell's parts, normalised."""
    return F.filter(F.transform(split_raw(text(c)), squeeze), lambda p: p != "")


def terms_of(parts: Column) -> Column:
    """struct(source, target) of each ``source=target`` part that has a target."""
    pair = lambda p: F.struct(squeeze(F.substring_index(p, "=", 1)).alias("source"), squeeze(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("target"))
    return F.filter(F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("="))), pair), lambda t: t["target"] != "")


def substring_count(t: Column, token: Column) -> Column:
    """Non-overlapping occurrences."""
    return F.when(token == "", F.lit(0)).otherwise(((F.length(t) - F.length(F.replace(t, token, F.lit("")))) / F.length(token)).cast("int"))


def token_count(t: Column, token: Column) -> Column:
    """Occurrences of a token; a number counts only where no digit or dot touches it."""
    runs = F.regexp_extract_all(t, F.lit("[0-9.]+"), F.lit(0))
    percents = F.regexp_extract_all(t, F.lit("[0-9.]+%(?![0-9.])"), F.lit(0))
    same = lambda found: F.size(F.filter(found, lambda r: r == token))
    return F.when(token.rlike(NUMERIC), F.when(F.endswith(token, F.lit("%")), same(percents)).otherwise(same(runs))).otherwise(substring_count(t, token))


def recall(t: Column, tokens: Column, count=token_count) -> Column:
    """struct(expected, matched, missing): how many of a multiset of tokens the text has."""
    each = F.transform(F.array_distinct(tokens), lambda k: F.struct(k.alias("k"), F.size(F.filter(tokens, lambda x: x == k)).alias("c"), count(t, k).alias("n")))
    matched = F.aggregate(each, F.lit(0), lambda acc, e: acc + F.least(e["n"], e["c"]))
    missing = F.array_join(F.flatten(F.transform(each, lambda e: F.array_repeat(e["k"], F.greatest(e["c"] - e["n"], F.lit(0))))), ";")
    return F.struct(F.size(tokens).alias("expected"), matched.alias("matched"), missing.alias("missing"))


def extra_text(t: Column) -> Column:
    """The first opening pattern that the text has, else the empty text."""
    return F.coalesce(*[F.when(t.rlike(FLAGS_NO_CASE + p), F.lit(p)) for p in EXTRA_TEXT], F.lit(""))


def has_markdown(t: Column) -> Column:
    found = F.lit(False)
    for p in MARKDOWN:
        found = found | t.rlike(FLAGS + p)
    return found


def is_quoted(t: Column) -> Column:
    found = F.lit(False)
    for a, b in QUOTES:
        found = found | (F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b)))
    return (F.length(t) >= 2) & found


def allowed_terms(protected: Column, terms: Column, source: Column, config: RuleConfig) -> Column:
    """Lower-cased English that a text may hold."""
    own = F.transform(F.filter(protected, lambda p: p.rlike("[A-Za-z]")), F.lower)
    sources = F.transform(F.filter(terms, lambda x: x["source"] != ""), lambda x: F.lower(x["source"]))
    marks = F.transform(F.regexp_extract_all(source, F.lit(PLACEHOLDER), F.lit(0)), F.lower)
    fixed = F.array(*[F.lit(str(x).lower()) for x in config.allowed_english_terms]).cast("array<string>")
    return F.array_distinct(F.concat(fixed, own, sources, marks))


@F.pandas_udf(IntegerType())
def _longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, by a suffix automaton of the shorter text: linear in both."""
    if len(a) > len(b):
        a, b = b, a
    step, link, size = [{}], [-1], [0]
    last = 0
    for c in a:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    at = run = best = 0
    for c in b:
        while at and c not in step[at]:
            at = link[at]
            run = size[at]
        if c in step[at]:
            at = step[at][c]
            run += 1
            best = max(best, run)
    return best


def longest_source_match(source: Column, t: Column) -> Column:
    """Of two normalised texts, regardless of case."""
    return _longest_common(F.lower(source), F.lower(t))


def residue(t: Column, allowed: Column, longest: Column, config: RuleConfig) -> Column:
    """struct(detected, ratio): English left in a text."""
    compact = F.length(F.regexp_replace(t, r"(?U)[\s\x{1C}-\x{1F}]+", ""))
    ratio = F.coalesce(F.try_divide(F.regexp_count(t, F.lit("[A-Za-z]")).cast("double"), compact.cast("double")), F.lit(0.0))
    words = F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z0-9_'-]*"), F.lit(0))
    odd = F.size(F.filter(words, lambda w: ~F.array_contains(allowed, F.lower(w))))
    detected = (odd >= config.english_word_warning_count) | (ratio >= config.english_ratio_warning) | (longest >= config.longest_source_match_warning)
    return F.struct(detected.alias("detected"), ratio.alias("ratio"))


def excess(output: Column, reference: Column, source: Column, config: RuleConfig) -> Column:
    """struct(excessive, ratio) from three lengths; no ratio without a reference."""
    ratio = F.try_divide(output.cast("double"), reference.cast("double"))
    long_for_reference = F.coalesce(ratio > config.max_reference_length_ratio, F.lit(False)) & (output >= config.minimum_excessive_length)
    long_for_source = (source <= 40) & (output >= 2 * config.minimum_excessive_length)
    return F.struct((long_for_reference | long_for_source).alias("excessive"), ratio.alias("ratio"))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The names whose conditions hold, in order."""
    named = [F.when(c, F.lit(n) if isinstance(n, str) else n) for c, n in pairs]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def request_reasons(success: Column, status: Column, error: Column, error_type: Column, empty: Column, finish: Column, config: RuleConfig) -> Column:
    """Why a request counts as failed; a blank status or flag is no reason."""
    return F.array_distinct(
        reasons(
            ((success != "") & ~is_truthy(success), "request_success=false"),
            (F.coalesce(status != 200, F.lit(False)), F.concat(F.lit("http_status="), status.cast("string"))),
            (error != "", "error"),
            (error_type != "", error_type),
            (empty, "empty_output"),
            (finish.isin([str(x).lower() for x in config.max_tokens_finish_reasons]), F.concat(F.lit("finish_reason="), finish)),
        )
    )


def apply_rules(raw: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """All columns of ``raw`` (``request_success`` overwritten) and the rule columns, typed.

    Narrow: no shuffle.  Unicode normalisation runs once for each text cell, in one
    Arrow stage.
    """
    has = set(raw.columns)
    cell = lambda c: text(c) if c in has else F.lit("")
    norm = {f"__{c}": normalize_text(cell(c)) for c in ("translation_ja", "source_en", "reference_ja", "finish_reason", "error", "error_type", "input_variant", "protected_tokens", "required_terms")}
    df = raw.withColumns(norm | {"__tokens": tokens_of(cell("protected_tokens")), "__parts": tokens_of(cell("required_terms"))})
    t, source = F.col("__translation_ja"), F.col("__source_en")
    df = df.withColumns({
        "__empty": F.lower(t).isin("", "null", "none", "nan"),
        "__terms": terms_of(F.col("__parts")),
        "__allowed": allowed_terms(split_semicolon(F.col("__protected_tokens")), terms_of(split_semicolon(F.col("__required_terms"))), source, config),
        "longest_source_match": F.when((t == "") | (source == ""), F.lit(0)).otherwise(longest_source_match(source, t)),
    })
    df = df.withColumns({
        "__request": request_reasons(cell("request_success"), to_int(cell("http_status")), F.col("__error"), F.col("__error_type"), F.col("__empty"), F.lower("__finish_reason"), config),
        "__protected": recall(t, F.col("__tokens")),
        "__required": recall(t, F.transform("__terms", lambda x: x["target"]), substring_count),
        "extra_text_pattern": extra_text(t),
        "markdown_detected": has_markdown(t),
        "unnecessary_quotes": F.lit(False) if config.allow_quotes else is_quoted(t),
        "__residue": residue(t, F.col("__allowed"), F.col("longest_source_match"), config),
        "output_length": F.length(t),
        "reference_length": F.length("__reference_ja"),
        "__excess": excess(F.length(t), F.length("__reference_ja"), F.length(source), config),
    })
    ok, protected, required = F.size("__request") == 0, F.col("__protected.expected") == F.col("__protected.matched"), F.col("__required.missing") == ""
    # no variant column means the standard one
    strict = F.lit(config.strict_terms) | (F.col("__input_variant") == "terminology")
    failures = reasons((~ok, "request_success=false"), (F.col("__empty"), "empty_output"), (~protected, "protected_tokens_missing"), (F.col("extra_text_pattern") != "", "extra_text_detected"), (F.col("markdown_detected"), "markdown_detected"), (F.col("__excess.excessive"), "excessive_length"), (~required & strict, "required_terms_missing"))
    warnings = reasons((~required & ~strict, "required_terms_missing"), (F.col("unnecessary_quotes"), "unnecessary_quotes"), (F.col("__residue.detected"), "english_residue_detected"))
    df = df.withColumns({"__failures": failures, "__warnings": warnings})
    status = F.when(F.size("__failures") > 0, "FAIL").when(F.size("__warnings") > 0, "WARN").otherwise("PASS")
    df = df.withColumns({
        "request_success": ok,
        "request_error_type": F.array_join("__request", ";"),
        "protected_tokens_pass": protected,
        "protected_token_expected_count": F.col("__protected.expected"),
        "protected_token_matched_count": F.col("__protected.matched"),
        "missing_protected_tokens": F.col("__protected.missing"),
        "required_terms_pass": required,
        "missing_required_terms": F.col("__required.missing"),
        "empty_output": F.col("__empty"),
        "extra_text_detected": F.col("extra_text_pattern") != "",
        "english_residue_detected": F.col("__residue.detected"),
        "english_character_ratio": F.col("__residue.ratio"),
        "excessive_length": F.col("__excess.excessive"),
        "output_length_ratio": F.col("__excess.ratio"),
        "rule_check_status": status,
        "failure_reasons": F.array_join("__failures", ";"),
        "warning_reasons": F.array_join("__warnings", ";"),
    })
    inherited = [c for c in raw.columns if c not in RULE_COLUMNS or c == "request_success"]
    return df.select(*inherited, *[c for c in RULE_COLUMNS if c != "request_success" or c not in inherited])


def as_cells(evaluated: DataFrame) -> DataFrame:
    """Booleans as true/false; the sinks format numbers."""
    return evaluated.select(*[bool_text(F.col(c)).alias(c) if k == "boolean" else F.col(c) for c, k in evaluated.dtypes])


def status_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("rule_check_status").agg(F.count("*").alias("row_count"))
