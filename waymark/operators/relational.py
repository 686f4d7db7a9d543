"""Queries over the store. All are lazy DataFrames; `now` is a parameter, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bandwidth_class, utc_text

DAY = 86400.0


def latest_probes(discoveries: DataFrame, column: str, value: str, limit: int = 10) -> DataFrame:
    """The last probes of a hash or a name."""
    found = discoveries.where(F.col(column) == value).orderBy(F.desc("probed_at"), F.desc("id")).limit(limit)
    return found.withColumn("probed_at_utc", utc_text(F.col("probed_at")))


def by_hash(discoveries: DataFrame, hash_hex: str, limit: int = 10) -> DataFrame:
    return latest_probes(discoveries, "ident_hash_hex", hash_hex.upper(), limit)


def by_name(discoveries: DataFrame, name: str, limit: int = 10) -> DataFrame:
    return latest_probes(discoveries, "i2p_dns_name", name, limit)


def summary(discoveries: DataFrame, routers: DataFrame, leasesets: DataFrame) -> DataFrame:
    """One row of counts over the store."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_one", F.lit(1))
    d = one(discoveries, F.count("*").alias("discoveries"), F.countDistinct("ident_hash_hex").alias("destinations"), F.coalesce(F.sum("reachable"), F.lit(0)).cast("long").alias("reachable"))
    r, ls = one(routers, F.count("*").alias("routers")), one(leasesets, F.count("*").alias("leasesets"))
    return d.join(r, "_one").join(ls, "_one").drop("_one")


def duplicate_count(discoveries: DataFrame) -> DataFrame:
    return discoveries.agg((F.count("*") - F.countDistinct(F.concat_ws("_", "ident_hash_hex", "probe_mode"))).alias("duplicates"))


def flagged(book: DataFrame, limit: int | None = None, hints: bool = False) -> DataFrame:
    """Destinations that need a review, the last probed first; with hints, what to look at."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    more = ["content_type", "title", *(["content_summary", "flags", "found_links"] if hints else [])]
    rows = book.where(F.col("needs_review") == 1).orderBy(F.desc("last_probed_at"), "dns_name")
    rows = rows.select("ident_hash_hex", *[F.coalesce(c, F.lit("")).alias(c) for c in ("dns_name", "b32_addr", *more)])
    return rows if limit is None else rows.limit(limit)


def ever_reachable(targets: DataFrame, discoveries: DataFrame) -> DataFrame:
    """Targets with a reachable discovery, by hash, or by name where they have none: two equi semi joins."""
    up = discoveries.where(F.col("reachable") == 1)
    hashed = targets.where("ident_hash_hex <> ''").join(up.select("ident_hash_hex").distinct(), "ident_hash_hex", "left_semi")
    named = targets.where("ident_hash_hex = ''").join(up.select("i2p_dns_name").distinct(), "i2p_dns_name", "left_semi")
    return hashed.select(*targets.columns).unionByName(named.select(*targets.columns))


def target_queue(targets: DataFrame, discoveries: DataFrame, mode: str = "all", now: float = 0.0, min_age_hours: float = 24, skip_backoff: bool = True, limit: int | None = None) -> DataFrame:
    """Targets in the order in which to probe them: once reachable first, then with a whole hash, then the oldest probe."""
    rows = targets.where(F.col("backoff_until") <= now) if skip_backoff else targets
    if mode == "reachable_only":
        rows = ever_reachable(rows, discoveries)
    elif mode == "never_probed":
        rows = rows.where("last_probed_at <= 0")
    elif mode == "stale":
        rows = rows.where(F.col("last_probed_at") < now - min_age_hours * 3600)
    elif mode != "all":
        raise ValueError(f"unknown mode: {mode}")
    up = discoveries.where("reachable = 1 and ident_hash_hex <> ''").select("ident_hash_hex").distinct().withColumn("_up", F.lit(0))
    rows = rows.join(up, "ident_hash_hex", "left").withColumn("up_rank", F.coalesce("_up", F.lit(1))).withColumn("hash_rank", F.when(F.length("ident_hash_hex") == 40, 0).otherwise(1))
    rows = rows.orderBy("up_rank", "hash_rank", "last_probed_at", "id").select("ident_hash_hex", "i2p_dns_name", "up_rank", "hash_rank", "last_probed_at")
    return rows if limit is None else rows.limit(limit)


def new_target_count(targets: DataFrame) -> DataFrame:
    """How many linked targets are still to be probed."""
    return targets.agg(F.count_if((F.col("source") == "linked") & (F.col("last_probed_at") <= 0)).alias("new_targets"))


def probe_order(probes: DataFrame) -> DataFrame:
    """Probe results, those that answered first, the fastest of them first."""
    return probes.orderBy(F.col("reachable").desc(), "response_time", "id")


def crawl_candidates(targets: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    rows = targets.where((F.col("source") == "linked") & (F.col("crawl_depth") == depth) & (F.col("last_probed_at") == 0)).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def pending_analyses(discoveries: DataFrame, targets: DataFrame, mode: str, now: float = 0.0, limit: int | None = None) -> DataFrame:
    """Destinations to analyse, each once: all reachable, those without a recent analysis, or those without any."""
    triple = ["ident_hash_hex", "b32_addr", "i2p_dns_name"]
    up = discoveries.where("reachable = 1")
    if mode == "reachable":
        rows = up.where(F.col("title").isNotNull() | (F.length("content_summary") > 0))
        done = F.min(F.when(F.length(F.coalesce("deep_analysis", F.lit(""))) == 0, 0).otherwise(1))
        rows = rows.groupBy(*triple).agg(done.alias("rank"), F.max("probed_at").alias("probed_at")).orderBy("rank", F.desc("probed_at"), *triple)
    elif mode == "stale":
        rows = up.join(targets.select("ident_hash_hex", "last_analyzed_at"), "ident_hash_hex", "left")
        rows = rows.where(F.coalesce("last_analyzed_at", F.lit(0.0)).isin(0.0) | (F.col("last_analyzed_at") < now - 30 * DAY))
        rows = rows.groupBy(*triple).agg(F.min(F.coalesce("last_analyzed_at", F.lit(0.0))).alias("rank"), F.max("probed_at").alias("probed_at")).orderBy("rank", F.desc("probed_at"), *triple)
    elif mode == "never_analyzed":
        rows = up.where(F.length(F.coalesce("deep_analysis", F.lit(""))) == 0)
        rows = rows.groupBy(*triple).agg(F.lit(0).alias("rank"), F.max("probed_at").alias("probed_at")).orderBy(F.desc("probed_at"), *triple)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return rows if limit is None else rows.limit(limit)


def _translatable() -> Column:
    return (F.col("reachable") == 1) & ~F.col("detected_lang").isin("", "en") & ~F.col("content_summary").ilike("%[original:%")


def pending_translations(discoveries: DataFrame, lang: str | None = None, limit: int | None = None) -> DataFrame:
    rows = discoveries.where(_translatable())
    rows = rows.where(F.col("detected_lang") == lang) if lang else rows
    rows = rows.select("id", "ident_hash_hex", "i2p_dns_name", "detected_lang", "content_summary", "title").orderBy("id")
    return rows if limit is None else rows.limit(limit)


def preflight(targets: DataFrame, discoveries: DataFrame, book: DataFrame, now: float) -> DataFrame:
    """(layer, n): how much each layer of a run has to do."""
    old = F.col("last_probed_at")
    layers = [
        (targets, {"targets_all": F.count("*"), "targets_never": F.count_if(old <= 0), "targets_stale": F.count_if(old < now - DAY)}),
        (ever_reachable(targets, discoveries), {"targets_reachable": F.count("*")}),
        (discoveries, {"translate": F.count_if(_translatable())}),
        (book, {"analyze": F.count_if((F.col("reachable") == 1) & F.col("interest_score").isNull()), "extractor": F.count_if(F.col("needs_review") == 1), "export": F.count("*")}),
    ]
    parts = [df.agg(*[n.alias(name) for name, n in own.items()]).select(F.inline(F.array(*[F.struct(F.lit(name).alias("layer"), F.col(name).alias("n")) for name in own]))) for df, own in layers]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def reachability_series(probes: DataFrame, bucket: str = "hour") -> DataFrame:
    """Probes by hour or day: total, reachable, unreachable and a whole percentage, halves to even."""
    label = F.date_format(F.timestamp_seconds("probed_at"), "yyyy-MM-dd" if bucket == "day" else "yyyy-MM-dd HH:00")
    rows = probes.groupBy(label.alias("ts_utc")).agg(F.count("*").alias("total_probes"), F.count_if(F.col("reachable") == 1).alias("reachable"), F.count_if(F.col("reachable") == 0).alias("unreachable"))
    return rows.withColumn("pct", F.bround(100.0 * F.col("reachable") / F.col("total_probes"), 0).cast("long")).orderBy("ts_utc")


def timeline(discoveries: DataFrame) -> DataFrame:
    """The latest discovery of each hash; ties all stay. A missing name is the address."""
    top = discoveries.groupBy("ident_hash_hex").agg(F.max("probed_at").alias("probed_at"))
    rows = discoveries.join(top, ["ident_hash_hex", "probed_at"])
    name = F.coalesce(F.nullif("i2p_dns_name", F.lit("")), "b32_addr")
    return rows.orderBy(F.desc("probed_at")).select(name.alias("dns_name"), "reachable", "status_code", utc_text(F.col("probed_at")).alias("probed_at_utc"))


def type_histogram(book: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.trim("content_type"), F.lit("")), F.lit("unknown"))
    return book.groupBy(kind.alias("content_type")).agg(F.count("*").alias("n"), F.count_if(F.col("reachable") == 1).alias("reachable")).orderBy(F.desc("n"), "content_type")


def best_probe(probes: DataFrame, keys: tuple[str, ...] = ("ident_hash_hex",)) -> DataFrame:
    """The best probe of each destination (reachable, then the longest body, then the fastest), with how it was reached."""
    k = list(keys)
    rank = F.struct("reachable", "body_length", -F.col("response_time"), -F.col("id"))
    up = lambda mode: F.bool_or((F.col("probe_mode") == mode) & (F.col("reachable") == 1))
    rows = probes.groupBy(*k).agg(F.max_by(F.struct(*[c for c in probes.columns if c not in k]), rank).alias("best"), up("b32").alias("by_b32"), up("dns").alias("by_dns"))
    via = F.when(F.col("by_b32") & F.col("by_dns"), "b32+dns").when(F.col("by_b32"), "b32").when(F.col("by_dns"), "dns").otherwise(F.col("best.probe_mode"))
    return rows.select(*k, via.alias("merged_via"), "best.*")


def destinations(routers: DataFrame, leasesets: DataFrame) -> DataFrame:
    """The union of both catalogs by hash, with how many of each it has."""
    r = routers.groupBy("ident_hash_hex").agg(F.count("*").alias("routers"), F.max("bandwidth_kbps").alias("bandwidth_kbps"))
    ls = leasesets.groupBy("ident_hash_hex").agg(F.count("*").alias("leasesets"))
    both = r.join(ls, "ident_hash_hex", "full_outer")
    return both.select("ident_hash_hex", F.coalesce("routers", F.lit(0)).alias("routers"), F.coalesce("leasesets", F.lit(0)).alias("leasesets"), "bandwidth_kbps").orderBy("ident_hash_hex")


def catalog_stats(routers: DataFrame, leasesets: DataFrame) -> DataFrame:
    bw = F.when(F.col("bandwidth_kbps") > 0, F.col("bandwidth_kbps"))
    r = routers.agg(F.count("*").alias("routers"), F.count_if(F.col("caps").contains("f")).alias("floodfills"), F.coalesce(F.avg(bw).cast("int"), F.lit(0)).alias("avg_kbps"), F.coalesce(F.max(bw), F.lit(0)).alias("max_kbps"))
    ls = leasesets.agg(F.count("*").alias("leasesets"))
    all_ = routers.select("ident_hash_hex").union(leasesets.select("ident_hash_hex")).agg(F.countDistinct("ident_hash_hex").alias("destinations"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(r).join(one(ls), "_one").join(one(all_), "_one").drop("_one")


def fastest_routers(routers: DataFrame, floodfill_only: bool = False, limit: int | None = None) -> DataFrame:
    rows = (routers.where(F.col("caps").contains("f")) if floodfill_only else routers).orderBy(F.desc("bandwidth_kbps"), "ident_hash_hex")
    rows = rows.select("ident_hash_hex", "caps", "bandwidth_kbps", bandwidth_class(F.col("bandwidth_kbps")).alias("bw_class"))
    return rows if limit is None else rows.limit(limit)


def language_fallback(book: DataFrame, discoveries: DataFrame) -> DataFrame:
    """The book with a blank language filled from the latest discovery of the hash."""
    last = Window.partitionBy("ident_hash_hex").orderBy(F.desc("probed_at"), F.desc("id"))
    lang = discoveries.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("ident_hash_hex", F.col("detected_lang").alias("_lang"))
    return book.join(lang, "ident_hash_hex", "left").withColumn("detected_lang", F.coalesce(F.nullif("detected_lang", F.lit("")), "_lang", F.lit(""))).drop("_lang")


def validate(results: DataFrame) -> DataFrame:
    """Six checks of smoke results (label, probe_ok, status_code, body_length, content_type, summary, stage_error)."""
    checks = {
        "probe_ok": F.col("probe_ok"),
        "status_in_range": (F.col("status_code") >= 100) & (F.col("status_code") < 500),
        "body_sufficient": F.col("body_length") >= 128,
        "content_classified": ~F.coalesce("content_type", F.lit("")).isin("", "unknown"),
        "summary_present": F.trim(F.coalesce("summary", F.lit(""))) != "",
        "no_fatal_error": F.coalesce("stage_error", F.lit("")) == "",
    }
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return results.select("*", failed.alias("failed_checks"), (F.size(failed) == 0).alias("passed"))


def exit_code(results: DataFrame, preflight_ok: bool = True) -> DataFrame:
    """The exit code of a smoke run: preflight, store, probe, extract, success, in this order."""
    code = F.when(F.lit(not preflight_ok), 5).when(F.bool_or("store_failed"), 3).when(F.bool_or("probe_failed"), 1).when(F.bool_or("extract_failed"), 2).otherwise(0)
    return results.agg(F.coalesce(code, F.lit(0)).alias("exit_code"))


def normalise_addresses(rows: DataFrame, column: str = "address") -> DataFrame:
    """Addresses as given (a hash, a name, or a URL) as (ident_hash_hex, i2p_dns_name)."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(column), r"^https?://", ""), r"/.*$", "")
    is_hash = plain.rlike("^[0-9a-fA-F]{40}$")
    return rows.select("*", F.when(is_hash, F.upper(plain)).otherwise("").alias("ident_hash_hex"), F.when(is_hash, "").otherwise(plain).alias("i2p_dns_name"))


def probe_url(name: Column, address: Column) -> Column:
    """Where to probe a destination: its name, else its address."""
    return F.concat(F.lit("http://"), F.coalesce(F.nullif(name, F.lit("")), address), F.lit("/"))
