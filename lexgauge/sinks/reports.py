"""Writing small report tables as single files, and large ones as folders."""

from __future__ import annotations

import csv
import io
import json
import math
import os
import uuid
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgauge.operators.inputs import positioned


def cell(v, places: int = 6) -> str:
    """None, NaN and infinities are blank, floats have ``places`` decimals, booleans are true and false."""
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"{v:.{places}f}" if isinstance(v, float) else str(v)


def write_csv(df: DataFrame, path: str | Path, columns: list[str] | None = None, overwrite: bool = False) -> None:
    """One UTF-8 file with a byte-order mark, rows in the table's order; rows stream through the driver."""
    path, names = Path(path), columns or df.columns
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n")
        out.writerow(names)
        for row in df.select(*[df[c] if c in df.columns else F.lit("").alias(c) for c in names]).toLocalIterator():
            out.writerow([cell(v) for v in row])


def _records(places: int):
    """Each row as the CSV record of ``write_csv``, without its line end."""

    def run(batches):
        for batch in batches:
            held: list[str] = []
            out = csv.writer(_Appending(held), lineterminator="")
            out.writerows([cell(v, places) for v in row] for row in zip(*(c.to_pylist() for c in batch.columns)))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    return run


class _Appending:
    def __init__(self, held: list[str]):
        self.write = held.append


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, overwrite: bool = False, places: int = 6) -> None:
    """One file with the bytes of ``write_csv``, written by the tasks, wherever Hadoop's file systems reach.

    Each partition of ``df`` writes a part; sorted tables (``orderBy``) have their partitions in order.  The mark
    and the header come in front.  The file system joins the parts where it can (HDFS, which moves no
    byte), else they are copied one after the other through a buffer of a megabyte.
    The file appears under its name only when it is whole; rows never pass through the driver as rows.
    """
    spark = df.sparkSession
    names = columns or df.columns
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    fs = hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop.fs.Path(path)) and not overwrite:
        raise FileExistsError(path)
    head = io.StringIO()
    csv.writer(head, lineterminator="\r\n").writerow(names)
    staged = f"{path}.parts-{uuid.uuid4().hex}"
    rows = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in names])
    rows.mapInArrow(_records(places), "value string").write.option("lineSep", "\r\n").text(staged)
    try:
        _join_parts(spark, fs, staged, ("\ufeff" + head.getvalue()).encode("utf-8"), path)
    finally:
        fs.delete(hadoop.fs.Path(staged), True)


def _join_parts(spark, fs, staged: str, head: bytes, path: str) -> None:
    """Header and parts as one file, moved to its name at the end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    at = hadoop.fs.Path
    parts = sorted((s.getPath() for s in fs.listStatus(at(staged)) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: int(p.getName().split("-")[1]))
    whole = at(f"{staged}/whole")

    def write(joined) -> None:
        out = fs.create(whole, True)
        try:
            out.write(bytearray(head))
            for p in joined:
                source = fs.open(p)
                try:
                    hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()

    try:
        write([])
        if parts:
            sources = spark.sparkContext._gateway.new_array(at, len(parts))
            for i, p in enumerate(parts):
                sources[i] = p
            fs.concat(whole, sources)
    except (Py4JJavaError, PySparkException):  # a file system that cannot
        write(parts)
    fs.mkdirs(at(path).getParent())
    if fs.exists(at(path)):
        fs.delete(at(path), False)
    if not fs.rename(whole, at(path)):
        raise OSError(f"{path} could not be put in place")


def write_json(data: dict, path: str | Path, overwrite: bool = False) -> None:
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_all(reports: dict[str, tuple[DataFrame, list[str]]], folder: str | Path, overwrite: bool = False) -> None:
    """All reports or, if a target exists, none."""
    folder = Path(folder)
    if not overwrite and (there := [n for n in reports if (folder / n).exists()]):
        raise FileExistsError(", ".join(there))
    for name, (df, columns) in reports.items():
        write_csv(df, folder / name, columns, True)


def prepare_results(path: str | Path, overwrite: bool = False, resume: bool = False) -> None:
    """An empty or resumed result file; one that is there and neither replaced nor resumed is an error."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.exists() and not overwrite and not resume:
        raise FileExistsError(f"{path} exists: resume or overwrite it")
    path.open("w" if overwrite else "a").close()


def append_rows(rows: list, columns: list[str], path: str | Path) -> None:
    """Append a batch of results to one CSV file, with a header if it is empty; on disk when this returns."""
    with Path(path).open("a", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n")
        if f.tell() == 0:
            out.writerow(columns)
        out.writerows([cell(r[c], 3) for c in columns] for r in rows)
        f.flush()
        os.fsync(f.fileno())


def append_results(df: DataFrame, path: str) -> None:
    """Append a batch of results as Parquet; a job that fails leaves no part of it."""
    df.write.mode("append").parquet(path)


def write_lines(lines: DataFrame, path: str | Path, overwrite: bool = False) -> int:
    """The lines of ``corpus_lines`` as one UTF-8 text file in their order; they stream through the driver."""
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with path.open("w", encoding="utf-8", newline="\n") as f:
        for n, row in enumerate(lines.orderBy("line_no").select("line").toLocalIterator(), 1):
            f.write(row[0] + "\n")
    return n


def corpus_lines(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """(line_no, id, line): one line an item by id, line breaks as spaces."""
    one = F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n|\n|\r", " "))
    return positioned(df.select(F.col(id_col).alias("id"), one.alias("line")), "id").withColumnRenamed("position", "line_no").select("line_no", "id", "line")


def write_corpora(df: DataFrame, folder: str, columns: list[str], by: str = "category", id_col: str = "id", overwrite: bool = False) -> None:
    """One corpus a column and category, ``<folder>/<column>/<by>=<value>/part-*``: a line an item in the order of ids, line breaks as spaces.

    All categories of a column are written in one job.  Rows are laid out by ranges of category and id, so a large
    category has several parts, whose names are in the lines' order; parts joined in that order
    are the corpus, and line k of every column's corpus is the same item.
    """
    for c in columns:
        line = F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\r\n|\n|\r", " "))
        rows = df.select(F.col(by), F.col(id_col).alias("__id"), line.alias("value")).repartitionByRange(by, "__id").sortWithinPartitions(by, "__id")
        rows.drop("__id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy(by).text(f"{folder.rstrip('/')}/{c}")
