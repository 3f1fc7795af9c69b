"""URL rules by hashed host-suffix and path-prefix expressions.

A URL such as ``https://a.b.org/x/y?q`` is expanded into every host suffix
(``a.b.org``, ``b.org``, ``org``) joined with every path prefix that ends in a
slash (``/``, ``/x/``).  Each expression's SHA-256 digest is cut to a short
prefix for the equi-join with the rules; the full digests then confirm the
match and the longest rule wins.  Expressions deeper than the deepest rule
cannot match, so the expansion stops there: its size is bounded by the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_keys, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the equi-join compares.
PREFIX_DIGITS = 8


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rules frame (verdict, host, path) from tuples; paths start and end with a slash."""
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or not (path.startswith("/") and path.endswith("/")):
            raise ValueError(f"not a rule: {(verdict, host, path)}")
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column, depth: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, depth)), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def _prefixes(path: Column, depth: Column) -> Column:
    parts = F.split(path, "/", -1)
    n = F.size(parts) - 1
    some = F.transform(F.sequence(F.lit(1), F.least(n, depth)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return F.when((n > 0) & path.startswith("/"), some).otherwise(F.array().cast("array<string>"))


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """pages with the columns host, path, rule and verdict.

    Null URLs and URLs without ``://`` have empty hosts and paths, match no rule
    and get the default.  An empty path starts with no rule's path.  Equal URLs
    are judged once, and pages with an URL that very many pages have are not
    dealt out by it; of rules with the same host and path, block wins.  Columns
    of pages with these four names are replaced; all others are kept.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new]
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("host is not null and path is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.", -1)).alias("hosts"), (F.size(F.split("path", "/", -1)) - 1).alias("paths"))
    deepest = rules.agg(F.coalesce(F.max("hosts"), F.lit(0)).alias("_hosts"), F.coalesce(F.max("paths"), F.lit(0)).alias("_paths")).first()
    rules = rules.select("rule", F.col("verdict").alias("_rv"), F.sha2("rule", 256).alias("_rd")).withColumn("_key", F.substring("_rd", 1, prefix_digits))

    urls = pages.select(F.col(f"`{url}`").alias("_url")).where("_url is not null").distinct().select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    found = urls.where((F.col("host") != "") & F.lit(deepest["_hosts"] > 0)).select("_url", F.explode(_suffixes(F.col("host"), F.lit(deepest["_hosts"]))).alias("_suffix"), _prefixes(F.col("path"), F.lit(deepest["_paths"])).alias("_prefixes"))
    found = found.select("_url", F.explode("_prefixes").alias("_prefix"), "_suffix").select("_url", F.sha2(F.concat("_suffix", "_prefix"), 256).alias("_digest"))
    found = found.withColumn("_key", F.substring("_digest", 1, prefix_digits)).join(rules, "_key").where("_digest = _rd")
    own = F.col(f"`{url}`")
    rows = pages.select(own.alias("_url"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
    best = found.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "_rv")).alias("_best"))
    out = spread_join(rows.where("_url is not null"), best, "_url", "left", heavy_keys(pages.select(own.alias("_url")), "_url"))
    out = out.unionByName(rows.where("_url is null").withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType)))
    return out.select("_row.*", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best._rv", F.lit(default)).alias("verdict"))
