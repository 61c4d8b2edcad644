"""URL filters: host-suffix and path-prefix expressions, joined by hash prefix.

A URL is expanded into suffixes of its host that begin at a label, times prefixes of
its path: those of as many labels and characters as some rule has, and no others, so that what is
made of a URL is bounded by the rules and not by its length. Each such expression meets the rules by the first
four bytes of its SHA-256; the whole digest then confirms it, and of the confirmed rules the longest wins.

Defined results: a URL that is null or has no ``://`` has an empty host and path
and gets the default verdict; so does a URL that no rule fits. A rule without a host, path or verdict, or of an empty
host, fits nothing. Rules may be of any number of
lengths. Equal URLs are judged once and every row gets its verdict, however long they are; other columns
are kept unless their names are those of the result, which replace them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.durable import durable, small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to so many rules are broadcast (under 20 MB of digests); more are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def expression(host: Column, path: Column) -> Column:
    """One string for a host and a path, from which both can be told."""
    return F.concat(host, F.lit("\n"), path)


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def digests(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The digests of the expressions of one URL: for each of ``shapes``, a number of labels and a length, of the last labels of the host and the
    beginning of the path, if they have so many. The shapes are one constant, so that the plan is as small for many as for few."""
    every = F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in shapes])), "array<struct<n:int,m:int>>")
    tail = lambda n: F.call_function("substring_index", host, F.lit("."), -n)
    fits = F.filter(every, lambda s: (labels_of(host) >= s["n"]) & (F.length(path) >= s["m"]))
    return F.transform(fits, lambda s: F.sha2(expression(tail(s["n"]), F.left(path, s["m"])), 256))


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has host, path and verdict. A rule fits its host and all below it, if the URL's path starts with the rule's. Of several
    rules of one host and path, block wins.
    """
    table = rules.select(F.translate("host", _UPPER, _LOWER).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")).where("rh <> '' AND rp IS NOT NULL AND rv IS NOT NULL")
    # as many rows as there are lengths of rules, however many rules
    shapes = sorted(map(tuple, table.select(labels_of(F.col("rh")), F.length("rp")).distinct().collect()))
    digest = F.sha2(expression(F.col("rh"), F.col("rp")), 256)
    table = table.groupBy(F.concat("rh", "rp").alias("rule"), digest.alias("digest")).agg(F.max("rv").alias("verdict")).withColumn("short", F.substring("digest", 1, 8))
    table = small(durable(table), BROADCAST_RULES)
    urls = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.select("_url", host_of(F.col("_url")).alias("h"), path_of(F.col("_url")).alias("p")).where("h <> ''")
    met = urls.select("_url", F.explode(digests(F.col("h"), F.col("p"), shapes)).alias("full")).withColumn("short", F.substring("full", 1, 8))
    best = (
        met.join(table, "short").where("full = digest")
        .groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
        .select("_url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    kept = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, F.col(url_col).alias("_url"))
    out = rows.join(best, "_url", "left")
    return out.select(*kept, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
