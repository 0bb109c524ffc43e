"""Reading item tables and trees of result files; every cell is text."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexgauge.functions.values import KEY, KEY_DEFAULTS, as_float, key_text
from lexgauge.operators import merge, quality
from lexgauge.operators.cut import checkpointed, written
from lexgauge.operators.quality import FINDING, K, findings

# The file kinds of a result tree and the columns they need.
KINDS = {"raw": "*raw_results.csv", "rule": "*rule_evaluation.csv", "comet": "*comet_scores.csv", "chrf": "*chrf_scores.csv", "human": "*human_evaluation.csv"}
NEEDED = {"raw": ["model_name", "run_id", "id", "request_success", "total_latency_ms"], "rule": ["model_name", "run_id", "id", "rule_check_status"]}


def header_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of one CSV file, without a byte-order mark."""
    first = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path).limit(1).collect()
    return next(csv.reader([first[0][0].lstrip("﻿").rstrip("\r")]), []) if first else []


def read_csv(spark: SparkSession, paths: str | list[str], header: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV files of one header as text columns, with ``file`` and ``record_no`` (1-based within a file).

    Quoted line breaks and doubled quotes are kept, missing cells are empty.  A file
    with quoted breaks is read by one task, so row numbers by task are in file order.
    """
    paths = [paths] if isinstance(paths, str) else paths
    names = header if header is not None else header_of(spark, paths[0], encoding)
    schema = StructType([StructField(c, StringType()) for c in names])
    df = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', encoding=encoding, enforceSchema=True).csv(paths)
    place = F.monotonically_increasing_id()
    df = df.fillna("").select(*[F.col(f"`{c}`") for c in names], F.col("_metadata.file_path").alias("file"), place.alias("__row"))
    first = df.groupBy("file").agg(F.min("__row").alias("__first"))
    return df.join(first, "file").withColumn("record_no", F.col("__row") - F.col("__first") + 1).drop("__row", "__first")


def _listing(spark: SparkSession, root: str, recursive: bool) -> list[tuple[str, bool]]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    out, todo = [], [path]
    while todo:
        for s in fs.listStatus(todo.pop()):
            out.append((s.getPath().toString(), s.isDirectory()))
            if recursive and s.isDirectory():
                todo.append(s.getPath())
    return sorted(out)


def bundle_dirs(spark: SparkSession, root: str) -> list[str]:
    """The folder itself if it holds raw and rule files directly, else its folders by name."""
    here = _listing(spark, root, False)
    files = [p for p, is_dir in here if not is_dir]
    if all(any(f.endswith(KINDS[k].lstrip("*")) for f in files) for k in ("raw", "rule")):
        return [root.rstrip("/")]
    return [p for p, is_dir in here if is_dir]


@dataclass
class Tree:
    facts: DataFrame | None
    findings: DataFrame
    bundles: list[str]


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in FINDING]))


def plain_path(p: str) -> str:
    """A path without its scheme and last slash."""
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", p).rstrip("/")


def is_smoke(file: str, bundle: str) -> bool:
    """Whether a file lies in a folder named smoke below its bundle."""
    return "smoke" in plain_path(file).removeprefix(plain_path(bundle)).split("/")[:-1]


WIDTH = 256  # columns of a result file at most


def width_bound(spark: SparkSession, root: str, encoding: str = "UTF-8") -> int:
    """A number of columns that no header below a folder exceeds, ``WIDTH`` + 1 at most; that many too if a line may have more than ``WIDTH`` cells.

    Spark's CSV reader does work for a short row that grows with the square of the schema's width, so files are
    not read wider than they are.
    """
    text = spark.read.options(encoding=encoding, lineSep="\n", recursiveFileLookup=True, pathGlobFilter="*.csv").text(root)
    line = F.regexp_replace("value", "^\ufeff|\r$", "")
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what)))
    cells = F.least(count(line, ",") + 1, F.lit(WIDTH + 1))
    odd = count(line, '"') % 2  # a quoted name goes on in the next line
    begins = F.when((F.col("_metadata.file_block_start") == 0) & (line != ""), F.monotonically_increasing_id() * 1024 + F.when(odd == 0, cells).otherwise(WIDTH + 1))
    bare = F.when(cells > WIDTH, count(F.regexp_replace(line, '"[^"]*"', ""), ",") >= WIDTH)
    files = text.select(F.col("_metadata.file_path").alias("file"), begins.alias("begins"), bare.alias("bare")).groupBy("file").agg((F.min("begins") % 1024).alias("n"), F.max("bare").alias("bare"))
    most = files.agg(F.max(F.when(F.col("bare"), WIDTH + 1).otherwise(F.col("n")))).first()[0]
    return int(most or 1)


def scan(spark: SparkSession, root: str, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(rows, heads) of all CSV files below a folder, in a few scans whatever their number and headers.

    heads: ``file``, ``header`` (its names, without a byte-order mark).  rows: ``file``, ``record_no`` (1-based below the header), ``cells``, a map of
    each name to its text; missing cells are empty.  Files are read whole by a task each, so their rows' numbers
    are in file order; a file without a line has neither.

    Rows meet their header by a broadcast, as there is one a file; none of their cells is sorted or shuffled here.
    """
    reader = spark.read.options(header=False, multiLine=True, quote='"', escape='"', encoding=encoding, recursiveFileLookup=True, pathGlobFilter="*.csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)

    def read(width: int) -> tuple[DataFrame, DataFrame]:
        """Lines of ``width`` cells, and each file's first."""
        schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
        cells = [F.col(f"_c{i}") for i in range(width)]
        if width > WIDTH:
            cells[WIDTH] = F.when(cells[WIDTH].isNotNull(), F.raise_error(F.concat(F.lit(f"more than {WIDTH} columns: "), F.col("_metadata.file_path")))).cast("string")
        df = reader.schema(schema).csv(root).select(F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("row"), F.array(*cells).alias("all"))
        return df, df.groupBy(F.col("__file").alias("file")).agg(F.min("row").alias("first"))

    bound = width_bound(spark, root, encoding)
    df, firsts = read(bound)
    here = df.join(F.broadcast(firsts), F.col("__file") == F.col("file"))
    names = F.transform(F.filter("all", lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, "^\ufeff", ""))
    heads = here.where(F.col("row") == F.col("first")).select("file", names.alias("header"))
    # of names that stand twice in a header the last counts; found once a file
    last = F.filter(F.transform("header", lambda x, i: F.struct(x.alias("name"), i.alias("at"))), lambda e, i: ~F.array_contains(F.slice("header", i + 2, F.lit(WIDTH)), e["name"]))
    heads = checkpointed(heads.withColumn("spots", last))
    # rows' numbers hold within a query: files may be dealt out otherwise in the next
    known = heads.select(F.col("file").alias("__f"), "spots").join(F.broadcast(firsts), F.col("__f") == F.col("file")).select("file", "first", "spots")
    beside = df.join(F.broadcast(known), F.col("__file") == F.col("file")).where(F.col("row") > F.col("first"))
    cells = F.map_from_arrays(F.col("spots.name"), F.transform(F.col("spots.at"), lambda i: F.coalesce(F.get("all", i), F.lit(""))))
    rows = beside.select("file", (F.col("row") - F.col("first")).alias("record_no"), cells.alias("cells"))
    return rows, heads.select("file", "header")


def over(first: Column, later: Column) -> Column:
    """Two maps as one; the later one's cell wins wherever it has the name, even if it is empty."""
    first, later = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (first, later))
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)


def _kind(file: Column) -> Column:
    return F.coalesce(*[F.when(file.endswith(p.lstrip("*")), F.lit(k)) for k, p in KINDS.items()])


def _keyed(rows: DataFrame) -> DataFrame:
    """With the composite key from the cells; an absent or blank part takes its default, the model's the bundle's name."""
    cell = lambda k: F.coalesce(F.col("cells")[k], F.lit(""))
    default = {k: F.lit(KEY_DEFAULTS[k]) if k in KEY_DEFAULTS else F.col("bundle") for k in KEY}
    return rows.withColumns({f"k_{k}": F.when(cell(k) != "", cell(k)).otherwise(default[k]) for k in KEY})


def _firsts(rows: DataFrame, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """The first row of each key of a bundle by file and record, and findings for all others and for rows without an id."""
    keys = ["bundle", *K]
    some = rows.where("k_id != ''")
    first = written(some.groupBy(*keys).agg(F.min(F.struct("file", "record_no")).alias("first")), "firsts").withColumnsRenamed({k: f"__{k}" for k in keys})
    # keys are as many as rows, and a packed table of them looks small: they must not go through the driver
    marked = some.join(first.hint("merge"), [F.col(k) == F.col(f"__{k}") for k in keys]).withColumn("is_first", F.struct("file", "record_no") == F.col("first"))
    again = findings(marked.where("not is_first"), "ERROR", f"{label}: duplicate composite key", F.col("k_model_name"), F.col("file"), key_text(*K))
    line = F.concat(F.lit("line "), (F.col("record_no") + 1).cast("string"))
    no_id = findings(rows.where("k_id = ''"), "ERROR", f"{label}: missing id", F.col("k_model_name"), F.col("file"), line)
    return marked.where("is_first").select(*keys, "cells"), [again, no_id]


def load_tree(spark: SparkSession, root: str, models: list[str] | None = None, exclude_smoke: bool = False, encoding: str = "UTF-8") -> Tree:
    """All bundles of a result tree as one fact table, and all findings.

    One scan reads all files of all bundles; a bundle is a column, and rows carry their cells by
    name until the columns are known.  So the number of jobs grows neither with files, nor with headers, nor
    with bundles.  A bundle is the folder itself if it holds raw and rule files directly, else each folder in it;
    one without usable raw or rule files has findings alone.

    Within a bundle the first row of a key counts, raw and rule rows meet by full outer join, and score
    files follow, the last file and record winning by column.  ``models`` keeps whole bundles by folder
    name or by the model name of any row.  Smoke runs (a bundle of that name, or a folder of that name within one)
    are left out only on request.
    """
    dirs = [d for d in bundle_dirs(spark, root) if not (exclude_smoke and plain_path(d).rsplit("/", 1)[-1] == "smoke" and plain_path(d) != plain_path(root))]
    flat = [plain_path(d) for d in dirs] == [plain_path(root)]
    if not dirs:
        return Tree(None, empty_findings(spark), [])
    rows, heads = scan(spark, root, encoding)
    below = F.substring(F.regexp_replace(F.expr("url_decode(replace(file, '+', '%2B'))"), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), len(plain_path(root)) + 2, 1 << 20)
    parts = F.split(below, "/")
    bundle = F.lit(plain_path(root).rsplit("/", 1)[-1]) if flat else F.get(parts, 0)
    inner = F.slice(parts, 1 if flat else 2, F.greatest(F.size(parts) - (1 if flat else 2), F.lit(0)))
    files = heads.withColumns({"bundle": bundle, "kind": _kind(F.col("file")), "inside": F.size(parts) > (0 if flat else 1), "smoke": F.array_contains(inner, "smoke")}).where("inside and kind is not null")
    if exclude_smoke:
        files = files.where(~F.col("smoke")) if flat else files.where("not smoke and bundle != 'smoke'")
    need = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.lit(c) for c in v])) for k, v in NEEDED.items()], F.array().cast("array<string>"))
    files = checkpointed(files.select("file", "bundle", "kind", "header", F.array_except(need, "header").alias("missing")))

    # a row a file; bundles and names are few
    seen = files.groupBy("bundle").agg(F.collect_set("kind").alias("kinds")).collect()
    kinds = {r["bundle"]: set(r["kinds"]) for r in seen}
    named = {plain_path(d).rsplit("/", 1)[-1]: d for d in dirs}
    absent = [("ERROR", n, d, "", f"missing {KINDS[k].lstrip('*')}") for n, d in named.items() for k in ("raw", "rule") if k not in kinds.get(n, ())]
    notes = [spark.createDataFrame(absent, ", ".join(f"{c} string" for c in FINDING))] if absent else []
    whole = sorted(n for n in named if {"raw", "rule"} <= kinds.get(n, set()))
    if not whole:
        return Tree(None, reduce(DataFrame.unionByName, notes, empty_findings(spark)), [])
    used = files.where(F.col("bundle").isin(whole))
    lacking = used.where(F.size("missing") > 0)
    notes.append(findings(lacking, "ERROR", F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")), F.col("bundle"), F.col("file")))
    good = used.where(F.size("missing") == 0)
    columns = sorted(r[0] for r in good.select(F.explode("header").alias("c")).distinct().collect())
    # written once, so that the files are not read again for each kind and finding
    cells = written(_keyed(rows.join(good.select(F.col("file").alias("__f"), "bundle", "kind", "header"), F.col("file") == F.col("__f"))), "cells")

    sides = []
    for k in ("raw", "rule"):
        side, found = _firsts(cells.where(F.col("kind") == k), k)
        sides.append(side)
        notes += found
    raw, rule = sides
    keys = ["bundle", *K]
    both = written(raw.withColumnRenamed("cells", "raw").join(rule.withColumnRenamed("cells", "rule").hint("merge"), keys, "full"), "pairs")
    alone = lambda c, issue: findings(both.where(F.col(c).isNull()), "ERROR", issue, F.col("k_model_name"), "", key_text(*K))
    notes += [alone("rule", "raw row has no matching rule_evaluation row"), alone("raw", "rule_evaluation row has no matching raw row")]
    facts = both.select(*keys, over(F.col("raw"), F.col("rule")).alias("cells"))

    scored = set().union(*(kinds[n] for n in whole))
    for k in (k for k in ("comet", "chrf", "human") if k in scored):
        mine = cells.where(F.col("kind") == k)
        line = F.concat(F.lit("line "), (F.col("record_no") + 1).cast("string"))
        notes.append(findings(mine.where("k_id = ''"), "WARNING", f"{k}: missing id", F.col("bundle"), F.col("file"), line))
        mine = mine.where("k_id != ''").withColumn("score_name", F.get(F.array_intersect(F.array(*[F.lit(c) for c in merge.SCORE_NAMES[k]]), "header"), 0))
        score = F.col("cells")[F.col("score_name")]
        if k in quality.RANGES:
            low, high, issue = quality.RANGES[k]
            notes.append(findings(mine.where(~as_float(score).between(low, high)), "WARNING", issue, F.col("k_model_name"), F.col("file"), key_text(*K)))
        own = F.filter(F.map_entries("cells"), lambda e: ~e["key"].isin(KEY) & ((e["key"] != F.col("score_name")) | F.col("score_name").isNull()))
        number = F.when(as_float(score).isNotNull(), F.array(F.struct(F.lit(f"{k}_score").alias("key"), score.alias("value")))).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
        each = mine.select(*keys, "file", "record_no", F.explode(F.concat(own, number)).alias("e"))
        last = each.groupBy(*keys, F.col("e.key").alias("c")).agg(F.max_by("e.value", F.struct("file", "record_no")).alias("v"))
        wide = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("more"))
        facts = facts.join(wide.hint("merge"), keys, "left").select(*keys, over(F.col("cells"), F.col("more")).alias("cells"))
    columns = sorted({*columns, *(f"{k}_score" for k in ("comet", "chrf", "human"))})
    if models:
        kept = facts.where(F.col("bundle").isin(models) | F.col("cells")["model_name"].isin(models) | (~F.map_contains_key("cells", "model_name") & F.col("k_model_name").isin(models))).select(F.col("bundle").alias("__b")).distinct()
        facts = facts.join(kept, F.col("bundle") == F.col("__b"), "left_semi")
    cell = lambda c: F.coalesce(F.col("cells")[c], F.col(f"k_{c}")) if c in KEY else F.col("cells")[c]
    facts = written(facts, "facts").select(*[cell(c).alias(c) for c in [*KEY, *[c for c in columns if c not in KEY]]], "bundle")
    names = sorted(r[0] for r in facts.select("bundle").distinct().collect())
    if not names:
        return Tree(None if models else facts, reduce(DataFrame.unionByName, notes), [] if models else whole)
    notes += [quality.item_set_diff(facts, baseline=names[0])] if len(names) > 1 else []
    notes.append(quality.negative_latency(facts))
    return Tree(facts, reduce(DataFrame.unionByName, notes, empty_findings(spark)), names)


def load_items(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Evaluation items with ``line_no`` in file order."""
    return read_csv(spark, path, encoding=encoding).withColumnRenamed("record_no", "line_no").drop("file")


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
