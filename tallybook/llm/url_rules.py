"""URL verdicts: host-suffix and path-prefix expressions meet rules by a short hash prefix, full digests confirm."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import saved

#: Hex characters of a digest that the join compares first.
PREFIX = 8
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All host suffixes of at most `labels` labels, each with all path prefixes of the given lengths that the path has."""
    parts = F.split(host, "\\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    `rules` has host, path and verdict. A rule fits its host and all subdomains where the path starts with the rule's; the
    longest rule wins, then the one with the longer host; of equal rules that disagree, block. Without one the rule is null
    and the verdict `default`. A null url and one without :// have an empty host and path. Rules with a null or empty host fit
    nothing, a null rule path is empty. Equal urls are judged once and joined back; other columns are not read.
    """
    rules = rules.where("host is not null and host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.max(F.size(F.split("host", "\\."))), F.collect_set(F.length("path"))).first()
    seen = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    if shape[0] is None:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict").withColumn("digest", F.sha2("rule", 256))
    known = known.withColumn("short", F.substring("digest", 1, PREFIX))
    asked = seen.select("host", "path").distinct()
    asked = asked.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shape[0], sorted(shape[1]))).alias("expression"))
    asked = asked.withColumn("own", F.sha2("expression", 256)).withColumn("short", F.substring("own", 1, PREFIX))
    met = asked.join(known, "short").where("own = digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "host_length", "rule", "verdict")).alias("b"))
    best = saved(best.select("host", "path", "b.rule", "b.verdict"), "judged")
    return seen.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
