"""Robots policies as arrays of rules, and whether they block a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rules(text: Column) -> Column:
    """Rules of a robots text: path_prefix, is_disallow, has_wildcard, has_suffix.

    Comments go, lines are lower-cased, agent groups are ignored. An empty `Disallow:` is a rule whose prefix is empty.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, "#.*$", ""))))

    def rule(x: Column) -> Column:
        value = F.trim(F.regexp_replace(x, r"^(dis)?allow:", ""))
        suffix = value.endswith("$")
        prefix = F.regexp_replace(value, r"\$$", "")
        return F.struct(prefix.alias("path_prefix"), x.startswith("disallow:").alias("is_disallow"), prefix.rlike(r"[*?]").alias("has_wildcard"), suffix.alias("has_suffix"))

    return F.transform(F.filter(lines, lambda x: x.rlike("^(dis)?allow:")), rule)


def matches(rule: Column, path: Column) -> Column:
    """Whether a rule fits a path: a wildcard pattern as a whole, an ending (less its first slash), or a prefix."""
    pattern = F.concat(F.lit(r"(?s)^\Q"), F.replace(F.replace(rule["path_prefix"], F.lit("*"), F.lit(r"\E.*\Q")), F.lit("?"), F.lit(r"\E.\Q")), F.lit(r"\E$"))
    ending = F.regexp_replace(rule["path_prefix"], "^/", "")
    return F.when(rule["has_wildcard"], F.regexp_like(path, pattern)).when(rule["has_suffix"], F.endswith(path, ending)).otherwise(F.startswith(path, rule["path_prefix"]))


def blocks(policy: Column, path: Column) -> Column:
    """Whether the policy blocks the path: the longest rule that fits decides, the first of equals; none allows."""
    own = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    fit = F.filter(policy, lambda r: matches(r, own))
    best = F.aggregate(fit, F.struct(F.lit(-1).alias("n"), F.lit(False).alias("block")), lambda a, r: F.when(F.length(r["path_prefix"]) > a["n"], F.struct(F.length(r["path_prefix"]).alias("n"), r["is_disallow"].alias("block"))).otherwise(a))
    return F.coalesce(best["block"], F.lit(False))


def fully_blocked(policy: Column) -> Column:
    """Whether some disallow rule fits the root; allow rules don't count."""
    return F.coalesce(F.exists(policy, lambda r: r["is_disallow"] & matches(r, F.lit("/"))), F.lit(False))


def keep_links(links: Column, policy: Column) -> Column:
    """Links of a page, none if its site is blocked as a whole."""
    return F.when(fully_blocked(policy), F.array().cast("array<string>")).otherwise(links)


def blocked_flag(links: Column, policy: Column) -> Column:
    """The flag that says how many links a blocked site lost; null if none."""
    return F.when(fully_blocked(policy) & (F.size(links) > 0), F.concat(F.lit("blocked_"), F.size(links), F.lit("_links (site fully blocked)")))
