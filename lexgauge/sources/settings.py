"""Threshold files: JSON objects, or the small YAML subset of sections and scalars."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from lexgauge.operators.inputs import SYSTEM_PROMPT
from lexgauge.operators.summaries import Thresholds


def scalar(word: str):
    """true and false, numbers, else the text without its quotes."""
    word = word.strip()
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    for kind in (int, float) if "." not in word else (float,):
        try:
            return kind(word)
        except ValueError:
            continue
    return word.strip("\"'")


def parse(data: str) -> dict:
    """Sections of scalars.

    In JSON only ``qualification`` and ``failed_case`` count.  In the YAML subset a
    line that ends in a colon at the margin opens a section, any later ``key: value``
    belongs to it whatever its indent, ``#`` begins a comment anywhere, list items
    are passed over.
    """
    try:
        given = json.loads(data)
    except json.JSONDecodeError:
        given = None
    else:
        if not isinstance(given, dict):
            raise ValueError("config must be a JSON or YAML object")
        return {k: v for k, v in given.items() if k in ("qualification", "failed_case") and isinstance(v, dict)}
    out: dict = {}
    into = out
    for line in data.splitlines():
        line = line.partition("#")[0].rstrip()
        if line and not line[0].isspace() and line.endswith(":"):
            into = out.setdefault(line[:-1].strip(), {})
        elif ":" in line:
            key, _, value = line.partition(":")
            into[key.strip()] = scalar(value)
    return out


def read_settings(path: str | Path, label: str) -> str:
    try:
        return Path(path).read_text("utf-8-sig")
    except OSError as e:
        raise ValueError(f"cannot read {label}: {e}") from e


def system_prompt(path: str | Path | None = None) -> str:
    """The instruction of a file, or the built-in one, without white space at its ends."""
    return (SYSTEM_PROMPT if path is None else read_settings(path, "system prompt file")).strip()


def json_option(value: str | None, label: str):
    """The value of a JSON text; None if there is none."""
    try:
        return json.loads(value) if value else None
    except ValueError as e:
        raise ValueError(f"{label} is not valid JSON: {e}") from e


def thresholds(data: str | None) -> tuple[Thresholds, float | None]:
    """(bounds, lowest acceptable score): defaults overlaid by a file; a bound that is no number is left out."""
    given = parse(data) if data else {}
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    own = given.get("qualification", {})
    bounds = Thresholds(**{f.name: number(own[f.name]) for f in fields(Thresholds) if f.name in own})
    return bounds, number(given.get("failed_case", {}).get("minimum_comet_score"))
