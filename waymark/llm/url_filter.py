"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, join_skewed

#: Hex digits of the digest that the join compares first.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of the longest rule that fits each url.

    rules has rule (a host, then a path that begins with `/`) and action (allow or block). A rule fits its host and all
    subdomains where the path starts with the rule's. Distinct (host, path) pairs are expanded into host suffixes and
    path prefixes of just the lengths that rules have; these meet the rules on a short prefix of their digests, and the
    whole digest confirms. Of fitting rules the longest wins, then the longer host, then block. Which side of the join
    is broadcast, Spark decides by its size. Pairs that some rule fits come back to their rows by a join in which pairs of
    very many rows are apart; urls without a host take no part.

    Returns the input's columns packed in `row`, with host, path, rule and verdict. A null url, or one without `://`,
    has an empty host and path and gets the default; repeated rows all stay; without rules all get the default.
    """
    spec = rules.where(F.col("rule").isNotNull()).select(
        "rule", "action", F.lower(F.substring_index("rule", "/", 1)).alias("rule_host"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"),
    )
    spec = spec.select(
        "action", "rule", F.length("rule_host").alias("host_length"), F.length("rule").alias("length"), F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.length("rule_path").alias("path_length"), F.sha2(F.concat("rule_host", "rule_path"), 256).alias("digest"),
    )
    shapes = sorted((r.labels, r.path_length) for r in spec.select("labels", "path_length").distinct().collect())
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tries = [F.when(F.length("path") >= n, F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k, n in shapes]
    tried = rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")).select("host", "path", "n", F.explode(F.array_distinct(F.array_compact(F.array(*tries)))).alias("text"))
    tried = tried.select("host", "path", "n", F.sha2("text", 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    met = tried.alias("t").join(spec.withColumn("short", F.substring("digest", 1, SHORT)).alias("r"), "short").where("t.digest = r.digest")
    order = F.struct("length", "host_length", (F.col("action") == "block").alias("blocks"), "rule", "action")
    best = cut(met.groupBy(F.struct("host", "path").alias("at"), "n").agg(F.max(order).alias("best")))
    rows = rows.withColumn("at", F.when(F.col("host") != "", F.struct("host", "path")))
    return join_skewed(rows, best, "at", "n").select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
