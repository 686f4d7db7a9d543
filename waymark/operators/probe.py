"""A sweep: targets are fetched, pages are read, probes go into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags as flag_functions
from ..functions import language, robots, scalars
from ..functions import pages as page_functions
from ..sources.fetch import Fetcher, fetch
from .backoff import apply_backoff
from .crawl import crawl_delay
from .extractors import Registry, run_builtin, run_plugins
from .merge import cleanup, expired, seed_links, upsert_discoveries
from .relational import target_queue
from .store import Store


def _read_by(pages: DataFrame, registry: Registry) -> DataFrame:
    """Pages that the built-in extractor read, with the registry's result where it gave no type and one of these claims the page."""
    names = ["content_type", "summary_lines", "links", "claimed", "extractor", "review_reason", "needs_review"]
    kept = [c for c in pages.columns if c not in names]
    both = run_plugins(pages.select(*kept, F.struct(*names).alias("_own")), registry)
    use = (F.col("_own.content_type") == "") & F.col("claimed")
    return both.select(*kept, *[F.when(use, F.col(c)).otherwise(F.col(f"_own.{c}")).alias(c) for c in names])


def probe(targets: DataFrame, fetcher: Fetcher, now: float, delay: float = 0.0, policies: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """Probes of targets, one by address and one by name where they have them: a row of the probe log each. registry:
    extractors for pages to which the built-in one gives no type."""
    t = targets.withColumn("b32", F.when(F.col("b32_addr") != "", F.col("b32_addr")).otherwise(scalars.b32_address(F.col("ident_hash_hex"))))
    ways = F.array_compact(F.array(*[F.when(F.col(c) != "", F.struct(F.lit(m).alias("mode"), F.col(c).alias("host"))) for c, m in (("b32", "b32"), ("i2p_dns_name", "dns"))]))
    w = t.select("ident_hash_hex", "i2p_dns_name", "b32", F.explode(ways).alias("w")).withColumn("url", F.concat(F.lit("http://"), "w.host", F.lit("/")))
    got = w.join(fetch(w.select("url").distinct(), fetcher, delay), "url")
    x = got.withColumn("raw", F.col("body")).withColumn("body", F.coalesce(F.decode("raw", "UTF-8"), F.lit(""))).withColumn("title", page_functions.title(F.col("body")))
    x = run_builtin(x) if registry is None else _read_by(run_builtin(x), registry)
    x = x.withColumn("lang", language.detect(F.col("title"), F.col("body"))["lang"]).withColumn("found_flags", flag_functions.flags(F.col("body"), F.col("headers"), F.lit(0)))
    own = F.array_except("links", F.array("i2p_dns_name", F.lit("")))
    if policies is not None:
        x = x.join(policies.withColumnRenamed("host", "policy_host"), F.col("w.host") == F.col("policy_host"), "left")
        lost = robots.blocked_flag(F.col("links"), F.col("policy"))
        x = x.withColumn("found_flags", F.when(lost.isNotNull(), F.array_append("found_flags", F.struct(F.lit("robots_txt").alias("type"), lost.alias("value")))).otherwise(F.col("found_flags")))
        own = robots.keep_links(own, F.coalesce("policy", F.array().cast("array<struct<path_prefix:string,is_disallow:boolean,has_wildcard:boolean,has_suffix:boolean>>")))
    lines = F.concat("summary_lines", flag_functions.flag_lines(F.col("found_flags")))
    return x.select(
        F.xxhash64("url").alias("id"), "ident_hash_hex", F.col("b32").alias("b32_addr"), "i2p_dns_name", F.col("w.mode").alias("probe_mode"), scalars.reachable(F.col("status")).cast("int").alias("reachable"),
        F.col("status").alias("status_code"), F.octet_length("raw").cast("long").alias("body_length"), F.col("elapsed").alias("response_time"), F.col("w.mode").alias("via_method"), "title",
        "content_type", F.col("lang").alias("detected_lang"), F.array_join(lines, "\n").alias("content_summary"), scalars.content_hash(F.col("raw")).alias("content_hash"),
        scalars.header(F.col("headers"), "Last-Modified").alias("last_modified"), F.to_json(own).alias("found_links"), F.to_json("found_flags").alias("flags"), "needs_review",
        F.col("error").alias("error_msg"), F.lit(now).alias("probed_at"),
    )


def sweep(store: Store, fetcher: Fetcher, now: float, mode: str = "all", limit: int | None = None, crawl_depth: int = 0, delay: float = 0.0) -> DataFrame:
    """Probes the queue, then, to the given depth, the sites that it links to; all go into the store. Returns the probes."""
    targets, found = store.read("targets"), store.read("discoveries")
    queue = target_queue(targets, found, mode, now, limit=limit).select("ident_hash_hex", "i2p_dns_name")
    todo, depth, every = targets.join(queue, ["ident_hash_hex", "i2p_dns_name"], "left_semi"), 0, None
    while True:
        store.write("probes", probe(todo, fetcher, now, delay if depth == 0 else crawl_delay(delay, depth)))
        new = store.read("probes")
        # what was found and what it means for the targets become visible together
        with store.commit() as c:
            c.merge("discoveries", new, upsert_discoveries)
            targets = apply_backoff(c.read("targets"), new)
            links = new.where("reachable = 1").select(F.explode(scalars.links_of(F.col("found_links"))).alias("i2p_dns_name"), F.coalesce(F.nullif("i2p_dns_name", F.lit("")), "b32_addr").alias("source_site"))
            c.write("targets", targets.unionByName(seed_links(targets, links, depth + 1, now)))
            found = c.read("discoveries")
            if found.where(expired(now)).limit(1).count():
                c.write("discoveries", cleanup(found, now))
        every = new if every is None else every.unionByName(new)
        depth += 1
        if depth > crawl_depth:
            return every
        todo = store.read("targets").where((F.col("source") == "linked") & (F.col("crawl_depth") == depth) & (F.col("last_probed_at") == 0))
        if not todo.limit(1).count():
            return every


