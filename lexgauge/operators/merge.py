"""The joined fact table: raw and rule rows, then optional score files, by composite key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.values import KEY, as_float

from .quality import K

# The names of a score column by file kind; the first one present counts.
SCORE_NAMES = {"comet": ["comet_score", "score", "comet", "COMET"], "chrf": ["chrf_score", "sentence_chrf", "chrf", "score"], "human": ["human_score", "score"]}


def score_column(columns: list[str], kind: str) -> str | None:
    return next((c for c in SCORE_NAMES[kind] if c in columns), None)


def full_merge(sources: list[DataFrame], outer: int = 2, keys: list[str] = K) -> DataFrame:
    """Rows of the first ``outer`` sources by full outer join, the others by left join.

    A later source's column wins wherever its row exists, even with an empty cell: a
    column counts by being there, not by being filled.  Each source has one row a
    key.  ``has_<i>`` tells which sources gave a row; a source may mark columns its
    file lacked by a null cell in ``__cols`` (an array of names), then earlier ones hold.
    """
    marked = [s.withColumn(f"has_{i}", F.lit(True)) for i, s in enumerate(sources)]
    out: DataFrame | None = None
    seen: set[str] = set()
    for i, s in enumerate(marked):
        own = [c for c in s.columns if c not in keys and c not in (f"has_{i}", "__cols")]
        rename = {c: f"__{i}_{c}" for c in own}
        s = s.withColumnsRenamed(rename | ({"__cols": f"__{i}_cols__"} if "__cols" in s.columns else {}))
        if out is None:
            out = s.withColumnsRenamed({v: k for k, v in rename.items()}).drop("__0_cols__")
            seen = set(own)
            continue
        out = out.join(s, keys, "full" if i < outer else "left")
        there = lambda c, i=i, cols=f"__{i}_cols__" in s.columns: F.col(f"has_{i}") & (F.array_contains(f"__{i}_cols__", c) if cols else F.lit(True))
        out = out.withColumns({c: F.when(there(c), F.col(f"__{i}_{c}")).otherwise(F.col(c)) if c in seen else F.when(there(c), F.col(f"__{i}_{c}")) for c in own})
        seen |= set(own)
        out = out.drop(*rename.values(), f"__{i}_cols__")
    return out


def fill_keys(merged: DataFrame, columns: set[str]) -> DataFrame:
    """Key columns that no source carries take the key's value; a blank cell that is there stays blank."""
    return merged.withColumns({k: F.coalesce(F.col(k), F.col(f"k_{k}")) if k in columns else F.col(f"k_{k}") for k in KEY})


def last_wins(files: list[DataFrame], kind: str, keys: list[str] = K) -> DataFrame | None:
    """One row a key from several score files: for each column the last file and record that has it.

    Each frame carries the key, ``file`` and ``record_no``.  The kind's score column
    becomes ``<kind>_score`` and counts only where it is a number.
    """
    parts = []
    for f in files:
        own = [c for c in f.columns if c not in keys and c not in (*KEY, "file", "record_no", "bundle")]
        score = score_column(own, kind)
        cells = [F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in own if c != score]
        if score:
            cells.append(F.when(as_float(score).isNotNull(), F.struct(F.lit(f"{kind}_score").alias("c"), F.col(score).alias("v"))))
        if cells:
            parts.append(f.select(*keys, "file", "record_no", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("e")))
    if not parts:
        return None
    names = sorted({c for f in files for c in f.columns if c not in keys and c not in (*KEY, "file", "record_no", "bundle")} | {f"{kind}_score"})
    cells = reduce(DataFrame.unionByName, parts)
    last = cells.groupBy(*keys, "e.c").agg(F.max_by("e.v", F.struct("file", "record_no")).alias("v"))
    wide = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
    return wide.select(*keys, F.map_keys("m").alias("__cols"), *[F.col("m")[n].alias(n) for n in names])
