"""Bounded crawl over a link table, a round of joins for each depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int = 2, max_new: int | None = None) -> DataFrame:
    """(site, depth, source_site, provenance_chain) of sites that links (source_site, target_site) reach from seeds (site).

    Each round joins the sites found last with their links and drops those known; of several ways to a site, the
    smallest source leads. Links and what a round finds are checkpointed, so a round doesn't do those before it again. max_new stops further rounds once as many were found, as a whole round is taken.
    """
    links = cut(links.where("target_site <> '' and source_site <> target_site").distinct())
    known = seeds.select("site").distinct().select("site", F.lit(0).alias("depth"), F.lit("").alias("source_site"), F.col("site").alias("provenance_chain"))
    edge, found = known, 0
    for depth in range(1, max_depth + 1):
        step = edge.select(F.col("site").alias("source_site"), "provenance_chain").join(links, "source_site")
        step = step.groupBy(F.col("target_site").alias("site")).agg(F.min(F.struct("source_site", "provenance_chain")).alias("way")).join(known.select("site"), "site", "left_anti")
        edge = cut(step.select("site", F.lit(depth).alias("depth"), "way.source_site", F.concat("way.provenance_chain", F.lit(" → "), "site").alias("provenance_chain")))
        if max_new is not None:
            found += edge.count()
        known = known.unionByName(edge)
        if max_new is not None and found >= max_new:
            break
    return known


def crawl_delay(base: float, depth: int) -> float:
    return base * (1 + 0.5 * (depth - 1))


def depth_stats(results: DataFrame) -> DataFrame:
    """Attempts, successes and failures by depth."""
    return results.groupBy("depth").agg(F.count("*").alias("attempted"), F.count_if(F.col("reachable") == 1).alias("ok"), F.count_if(F.col("reachable") == 0).alias("failed"))
