"""Allow and block lists over a trie of reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to this many rules the trie is broadcast; above, rules and urls are joined.
MAX_TRIE_RULES = 200_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Trie:
    """Host labels from the top level down, then whole path segments, then the rest of a rule's path.

    A node is a dict of children; under the key None it holds its path root, and
    under 0 the rules that end within the segment below it, as (rest, rule).
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for r in rules:
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, rest = r.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(0, []).append((rest, r))

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule (by its name; ties: the smallest name, then allow) that fits."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(None)
            k = 0
            while at is not None and k < len(segments):
                for rest, rule in at.get(0, ()):
                    if segments[k].startswith(rest) and (best is None or self.order(rule) < self.order(best)):
                        best = rule
                at = at.get(segments[k])
                k += 1
        return best

    @staticmethod
    def order(r: Rule) -> tuple:
        return (-len(r.name), r.name, r.verdict)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """Add host, path, rule (null without one) and verdict to each row.

    A rule fits its host and all subdomains where the url's path starts with the
    rule's; the longest wins.  Null urls and urls without ``://`` have an empty host
    and path and so the default verdict.  Up to ``max_trie_rules`` rules the trie
    travels in a broadcast variable, checked by that count; beyond it the rules
    become a table (``join_rules``).  Existing columns of these names are replaced.
    """
    spark = pages.sparkSession
    if default not in ("allow", "block"):
        raise ValueError("default must be allow or block")
    named = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if len(rules) > max_trie_rules:
        return join_rules(named, spark.createDataFrame([(*r, r.name) for r in rules], "r_host string, r_path string, r_verdict string, r_name string"), default)
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        found = [match(h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [r and r.name for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

    kept = [F.col(f"`{c}`") for c in named.columns if c not in ("rule", "verdict", "__judged")]
    return named.withColumn("__judged", judge("host", "path")).select(*kept, "__judged.rule", "__judged.verdict")


def join_rules(named: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by an equi-join, for rule lists that are too large to broadcast.

    Each distinct (host, path) meets the rules under its host suffixes and whole
    path prefixes, so a row makes (labels x segments) candidates and no row meets
    all rules of a host.
    """
    pairs = named.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    probes = pairs.withColumn("r_host", F.explode(suffix)).withColumn("r_stem", F.explode(prefix))
    stems = rules.withColumn("r_stem", F.regexp_extract("r_path", r"^((?s).*)/[^/]*$", 1)).withColumn("r_depth", F.size(F.split("r_path", "/")))
    probes = probes.withColumn("r_depth", F.when(F.col("r_stem") == "", F.lit(None)).otherwise(F.size(F.split("r_stem", "/")) + 1))
    on = (probes.r_host == stems.r_host) & (probes.r_stem == stems.r_stem) & F.startswith(F.col("path"), F.col("r_path"))
    best = probes.join(stems, on).groupBy("host", "path").agg(F.min(F.struct((-F.length("r_name")).alias("n"), F.col("r_name").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("__best"))
    kept = [F.col(f"`{c}`") for c in named.columns if c not in ("rule", "verdict")]
    return named.join(best, ["host", "path"], "left").select(*kept, F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


#: The rules that the query judges by.
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(r_host, r_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits AS (
  SELECT p.page_id, p.host, p.path, r.r_host || r.r_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.r_host || r.r_path) DESC NULLS LAST, r.r_host || r.r_path) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.r_host OR suffix(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""
