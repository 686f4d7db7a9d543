"""The address book: one row for each destination, from its latest probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import analysed, content_depth, interest_score, stability_index, utc_text

#: Columns of the book, in order.
COLUMNS = (
    "dns_name content_type reachable last_probed_utc content_summary deep_site_type deep_purpose deep_analyzed_at ident_hash_hex b32_addr status_code "
    "body_length title response_time_sec detected_lang via_method last_probed_at content_hash last_modified found_links flags needs_review interest_score "
    "interest_reasons content_depth stability_index deep_analysis bandwidth_kbps router_caps num_leases"
).split()
_DOT = " · "


def number_text(x: Column) -> Column:
    """A number without a zero fraction."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def rich_summary() -> Column:
    """A sentence on a destination, from its state, title, type, language, size, time and summary."""
    name, head = F.col("dns_name"), F.replace(F.col("title"), F.lit('"'), F.lit("'"))
    kind = F.coalesce(F.nullif("content_type", F.lit("")), F.lit("unknown"))
    lang = F.when((F.length("detected_lang") == 2) & (F.col("detected_lang") != "en"), F.concat(F.lit(" (originally "), F.col("detected_lang"), F.lit(")"))).otherwise("")
    kb = F.when(F.col("body_length") > 0, number_text(F.round(F.col("body_length") / 1024.0, 3))).otherwise("")
    seconds = F.round(F.coalesce("response_time_sec", F.lit(-1.0)), 1).cast("string")
    text = F.substring(F.replace(F.replace(F.col("content_summary"), F.lit("\n"), F.lit(_DOT)), F.lit("\r"), F.lit("")), 1, 200)
    short = F.substring(F.replace(F.col("content_summary"), F.lit("\n"), F.lit(_DOT)), 1, 200)
    titled = F.coalesce("title", F.lit("")) != ""
    base = F.concat(name, F.lit(' ("'), head, F.lit('") ['), kind, F.lit("]"))
    return (
        F.when(F.col("reachable") == 0, F.concat(name, F.lit(" — currently unreachable")))
        .when(titled & (F.length("content_summary") > 30), F.concat(base, lang, F.lit(" "), kb, F.lit("KB in "), seconds, F.lit("s — "), text))
        .when(titled, base)
        .when(F.length("content_summary") > 10, F.concat(name, F.lit(" — "), short))
        .otherwise(F.concat(name, F.lit(" (no content data)")))
    )


def address_book(discoveries: DataFrame, routers: DataFrame, leasesets: DataFrame) -> DataFrame:
    """One row for each destination, by name or by address: its latest probe, with its router, lease set and analysis.

    All windows share one key, so one shuffle; the time of the last analysed probe of a hash, a correlated lookup by its
    nature, is aggregated first and joined. Which side of a join is small enough to broadcast, Spark finds from sizes.
    """
    key = F.when(F.col("i2p_dns_name") != "", F.col("i2p_dns_name")).otherwise(F.col("b32_addr"))
    d = discoveries.withColumn("_key", key)
    own = Window.partitionBy("_key")
    latest = own.orderBy(F.desc("probed_at"), F.desc("id"))
    d = d.withColumns({
        "_b32": F.max(F.nullif("b32_addr", F.lit(""))).over(own),
        "_dns": F.max(F.nullif("i2p_dns_name", F.lit(""))).over(own),
        "_rn": F.row_number().over(latest),
    }).where("_rn = 1")
    d = d.withColumn("dns_name", F.coalesce("_dns", "_b32")).withColumn("b32_addr", F.col("_b32")).withColumnRenamed("response_time", "response_time_sec").withColumnRenamed("probed_at", "last_probed_at")
    deep = discoveries.where(F.length("deep_analysis") > 50).groupBy("ident_hash_hex").agg(utc_text(F.max("probed_at")).alias("deep_analyzed_at"))
    r = routers.select("ident_hash_hex", "bandwidth_kbps", F.col("caps").alias("router_caps"))
    ls = leasesets.select("ident_hash_hex", "num_leases")
    x = d.join(r, "ident_hash_hex", "left").join(ls, "ident_hash_hex", "left").join(deep, "ident_hash_hex", "left")
    field = lambda path: F.when(analysed(F.col("deep_analysis")), F.get_json_object("deep_analysis", path))
    x = x.withColumns({
        "last_probed_utc": utc_text(F.col("last_probed_at")),
        "deep_site_type": F.trim(F.replace(field("$.site_type"), F.lit("\n"), F.lit("· "))),
        "deep_purpose": F.replace(F.substring(field("$.purpose"), 1, 200), F.lit("\n"), F.lit(_DOT)),
        "interest_score": interest_score(F.col("deep_analysis")),
        "interest_reasons": field("$.interest_reasons"),
        "content_depth": content_depth(F.col("found_links"), F.col("body_length")),
        "stability_index": stability_index(F.col("response_time_sec"), F.col("bandwidth_kbps"), F.col("num_leases")),
        "content_summary": rich_summary(),
    })
    return x.select(*COLUMNS)
