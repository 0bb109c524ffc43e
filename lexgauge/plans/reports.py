"""The report set of an evaluation: from a fact table to named tables and a summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from lexgauge.operators import summaries as s
from lexgauge.operators.cut import checkpointed
from lexgauge.operators.facts import typed
from lexgauge.operators.quality import FINDING
from lexgauge.operators.summaries import Thresholds


def report_tables(facts: DataFrame, findings: DataFrame, bounds: Thresholds = Thresholds(), minimum_comet: float | None = None, accuracy_run: str | None = "1") -> dict[str, tuple[DataFrame, list[str]]]:
    """File name to (table, columns); the typed facts are written once, and all reports read them."""
    f = checkpointed(typed(facts))
    models = s.model_summary(f, accuracy_run=accuracy_run, thresholds=bounds)
    noise, stability = s.noise_summary(f), s.stability_summary(f)
    notes = findings.unionByName(s.unpaired(f))
    groups = {n: (s.sort_groups(s.group_summary(f, k), k), s.GROUP_COLUMNS) for n, k in (("category_summary.csv", s.CATEGORY), ("subcategory_summary.csv", s.SUBCATEGORY), ("difficulty_summary.csv", s.DIFFICULTY))}
    noisy = s.noise_summary(f, True)
    return {
        "model_summary.csv": (models.orderBy("bundle"), s.MODEL_COLUMNS),
        **groups,
        "ocr_summary.csv": (noise.orderBy("model_name"), noise.columns),
        "ocr_subcategory_summary.csv": (noisy.orderBy("model_name", "subcategory"), noisy.columns),
        "stability_summary.csv": (stability.orderBy("model_name", "input_variant"), stability.columns),
        "failed_cases.csv": (s.sort_failed(s.failed_cases(f, minimum_comet)), s.FAILED_COLUMNS),
        "data_quality_report.csv": (notes, FINDING),
        "final_comparison.csv": (s.sort_final(s.final_comparison(models, noise, stability)), s.FINAL_COLUMNS),
    }


def summary_document(tables: dict[str, tuple[DataFrame, list[str]]], bundles: list[str], settings: dict) -> dict:
    """The report set's head: when and with what it was made, and the per-model rows."""
    models = [r.asDict() for r in tables["model_summary.csv"][0].collect()]
    notes = {r[0]: r[1] for r in tables["data_quality_report.csv"][0].groupBy("severity").count().collect()}
    return {"generated_at": time.strftime("%Y-%m-%dT%H:%M:%S%z"), "bundles": bundles, "settings": settings, "models": models, "data_quality": notes}
