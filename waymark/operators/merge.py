"""Keyed merges. Each takes the stored table and a batch and returns the whole new table; the caller commits it.

A batch is folded to one row a key first, in order of `seq`, so a merge shuffles each side once by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import b32_address
from ..schemas import KEPT, UNTOUCHED

SUMMARY_LENGTH = 4096
#: What a column without a value holds, by its type.
EMPTY = {"string": "", "double": 0.0, "int": 0, "bigint": 0}
STALE_SOURCE, EXPORT_SOURCE = "addressbook:stale", "susi_export:"


def latest(col: str, seq: Column) -> Column:
    return F.max_by(col, seq).alias(col)


def latest_filled(col: str, empty: str, seq: Column) -> Column:
    """The last value that isn't empty; the empty value if all are."""
    return F.coalesce(F.max_by(col, F.when(F.col(col) != empty, seq)), F.lit(empty)).alias(col)


def fold_probes(probes: DataFrame, seq: Column | None = None, held: dict[str, Column] | None = None) -> DataFrame:
    """A probe log as its upserts leave it: a row for each (ident_hash_hex, probe_mode).

    The last probe overwrites, but an empty name, title, error, link list or flag list keeps the value before. The id is
    that of the first probe. Rows without a hash are told apart by their name. held: aggregates that take the place of
    these rules for some columns.
    """
    seq, held = F.struct("probed_at", "id") if seq is None else seq, held or {}
    own = F.coalesce(F.nullif("ident_hash_hex", F.lit("")), "i2p_dns_name")
    rest = [c for c in probes.columns if c not in KEPT and c not in ("id", "probe_mode", "content_summary", *held)]
    found = probes.groupBy(own.alias("_key"), "probe_mode").agg(
        F.min_by("id", seq).alias("id"), *[latest(c, seq) for c in rest], *[latest_filled(c, e, seq) for c, e in KEPT.items() if c in probes.columns and c not in held],
        *([F.substring(F.max_by("content_summary", seq), 1, SUMMARY_LENGTH).alias("content_summary")] if "content_summary" in probes.columns and "content_summary" not in held else []),
        *[x.alias(c) for c, x in held.items()],
    )
    return found.select(*probes.columns)


def upsert_discoveries(stored: DataFrame, probes: DataFrame) -> DataFrame:
    """The stored rows with a batch of probes merged in, with all columns of the stored table.

    An analysis stays on its row whatever the probes say, and so does any column that the batch lacks; on new rows such a
    column is empty (0, or null if it is neither a text nor a number). Columns that only the batch has are left out. A
    batch without rows, or one that is merged again, changes nothing.
    """
    kinds = dict(stored.dtypes)
    lacking = [c for c in stored.columns if c not in probes.columns and c not in UNTOUCHED]
    lacking += [c for c in ("deep_analysis",) if c in stored.columns]
    empty = lambda c: F.lit(KEPT.get(c, EMPTY.get(kinds[c]))).cast(kinds[c])
    new = probes.select(*[F.col(c) if c in probes.columns and c not in lacking else F.lit(None).cast(kinds[c]).alias(c) for c in stored.columns])
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    seq = F.struct("_new", "probed_at", "id")
    # max_by passes over rows without an order, so a value of the stored row, or none
    held = {c: F.coalesce(F.max_by(c, F.when(F.col("_new") == 0, seq)), empty(c)) for c in lacking}
    return fold_probes(both, seq, held).drop("_new")


def _merge_hosts(stored: DataFrame, new: DataFrame, overwrite: list[str]) -> DataFrame:
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, F.col("s.ident_hash_hex") == F.col("n.ident_hash_hex"), "full_outer")
    fresh = F.col("n.ident_hash_hex").isNotNull()

    def column(c: str) -> Column:
        if c == "ident_hash_hex":
            return F.coalesce("n.ident_hash_hex", "s.ident_hash_hex").alias(c)
        if c == "i2p_dns_name":
            return F.coalesce(F.nullif("n.i2p_dns_name", F.lit("")), "s.i2p_dns_name", F.lit("")).alias(c)
        if c not in new.columns:
            return F.col(f"s.{c}").alias(c)
        if c in overwrite:
            return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        return F.when(F.col("s.ident_hash_hex").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    return both.select(*[column(c) for c in stored.columns])


def upsert_routers(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Routers by hash: all columns are overwritten but the source; an empty name keeps the old one."""
    return _merge_hosts(stored, new, [c for c in stored.columns if c not in ("ident_hash_hex", "i2p_dns_name", "source")])


def upsert_leasesets(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Lease sets by hash: store type, count, name and time are overwritten."""
    return _merge_hosts(stored, new, ["store_type", "num_leases", "updated_at"])


def replace_children(stored: DataFrame, new: DataFrame, parents: DataFrame, key: str = "ident_hash_hex") -> DataFrame:
    """Child rows after their parents were read anew: the parents' old children go, whether they have new ones or not."""
    kept = stored.join(parents.select(key).distinct(), key, "left_anti")
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))


def _new_targets(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows with the columns of the target table; those they lack are empty or 0."""
    empty = {"string": F.lit(""), "double": F.lit(0.0), "int": F.lit(0), "bigint": F.lit(None).cast("bigint"), "long": F.lit(None).cast("long")}
    return rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else empty[t].alias(c) for c, t in like.dtypes])


def insert_targets(stored: DataFrame, pairs: DataFrame, source: str, now: float) -> DataFrame:
    """Targets with new (ident_hash_hex, i2p_dns_name) pairs added; known pairs stay, with a new time if both sides are of
    the address book."""
    keys = ["ident_hash_hex", "i2p_dns_name"]
    pairs = pairs.select(*keys).dropDuplicates(keys)
    known = stored.join(pairs.withColumn("_again", F.lit(True)), keys, "left")
    known = known.withColumn("last_updated_at", F.when(F.col("_again") & (F.lit(source) == "addressbook") & (F.col("source") == "addressbook"), F.lit(now)).otherwise(F.col("last_updated_at"))).select(*stored.columns)
    fresh = pairs.join(stored.select(*keys), keys, "left_anti").withColumn("source", F.lit(source)).withColumn("b32_addr", b32_address(F.col("ident_hash_hex"))).withColumn("last_updated_at", F.lit(now))
    return known.unionByName(_new_targets(fresh, stored))


def seed_links(stored: DataFrame, links: DataFrame, depth: int, now: float = 0.0) -> DataFrame:
    """New targets from links (i2p_dns_name, source_site): names that no target has, each once, with the chain of sites
    that led to it."""
    fresh = links.where(F.coalesce("i2p_dns_name", F.lit("")) != "").groupBy("i2p_dns_name").agg(F.min("source_site").alias("source_site"))
    fresh = fresh.join(stored.select("i2p_dns_name").distinct(), "i2p_dns_name", "left_anti")
    parents = stored.where("i2p_dns_name <> ''").groupBy(F.col("i2p_dns_name").alias("source_site")).agg(F.max("provenance_chain").alias("parent_chain"))
    fresh = fresh.join(parents, "source_site", "left")
    seed = F.coalesce(F.nullif("parent_chain", F.lit("")), "source_site")
    chain = F.when(F.coalesce("source_site", F.lit("")) == "", F.col("i2p_dns_name")).otherwise(F.concat(seed, F.lit(" → "), F.col("i2p_dns_name")))
    return _new_targets(fresh.select("i2p_dns_name", F.coalesce("source_site", F.lit("")).alias("source_site"), chain.alias("provenance_chain"), F.lit("linked").alias("source"), F.lit(depth).alias("crawl_depth"), F.lit(now).alias("last_updated_at")), stored)


def import_entries(stored: DataFrame, entries: DataFrame, book: str, generation: int, now: float) -> DataFrame:
    """Targets after an import of hosts entries: all imported targets are switched off, those of this import get its
    generation, unknown ones are added."""
    keys = ["ident_hash_hex", "i2p_dns_name"]
    new = entries.where(F.coalesce("i2p_dns_name", F.lit("")) != "").groupBy(*keys).agg(F.max(F.col("dest_b64") if "dest_b64" in entries.columns else F.lit("")).alias("_blob"))
    old = stored.join(new, keys, "left")
    hit = F.col("_blob").isNotNull()
    off = F.col("source").startswith(EXPORT_SOURCE)
    old = old.withColumns({
        "susi_active": F.when(hit, F.lit(generation)).when(off, F.lit(0)).otherwise(F.col("susi_active")),
        "source": F.when(hit, F.lit(EXPORT_SOURCE + book)).otherwise(F.col("source")),
        "last_updated_at": F.when(hit, F.lit(now)).otherwise(F.col("last_updated_at")),
        "dest_data": F.when(hit & (F.col("_blob") != ""), F.col("_blob")).otherwise(F.col("dest_data")),
    })
    fresh = new.join(stored.select(*keys), keys, "left_anti").select(*keys, F.col("_blob").alias("dest_data"), F.lit(EXPORT_SOURCE + book).alias("source"), b32_address(F.col("ident_hash_hex")).alias("b32_addr"), F.lit(generation).alias("susi_active"), F.lit(now).alias("last_updated_at"))
    return old.select(*stored.columns).unionByName(_new_targets(fresh, stored))


def fill_dest_data(stored: DataFrame, blobs: DataFrame) -> DataFrame:
    """Targets whose blob is missing or shorter than 20 characters get that of their hash."""
    one = blobs.groupBy("ident_hash_hex").agg(F.max("dest_b64").alias("_blob"))
    blob = F.when((F.length(F.coalesce("dest_data", F.lit(""))) < 20) & F.col("_blob").isNotNull(), F.col("_blob")).otherwise(F.col("dest_data"))
    return stored.join(one, "ident_hash_hex", "left").withColumn("dest_data", blob).select(*stored.columns)


def clear_review(discoveries: DataFrame, hash_hex: str) -> DataFrame:
    """Discoveries with the review mark off on the latest rows of a hash."""
    # one row, so that the other hashes' rows are only passed through
    top = discoveries.where(F.col("ident_hash_hex") == hash_hex).groupBy("ident_hash_hex").agg(F.max("probed_at").alias("_top"))
    latest = F.col("probed_at") == F.col("_top")
    return discoveries.join(F.broadcast(top), "ident_hash_hex", "left").withColumn("needs_review", F.when(latest, 0).otherwise(F.col("needs_review"))).select(*discoveries.columns)


def clear_reviews(discoveries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Discoveries with the review mark off on the latest rows of the given hashes (ident_hash_hex)."""
    top = discoveries.join(hashes.select("ident_hash_hex").distinct(), "ident_hash_hex", "left_semi").groupBy("ident_hash_hex").agg(F.max("probed_at").alias("_top"))
    latest = F.col("probed_at") == F.col("_top")
    return discoveries.join(top, "ident_hash_hex", "left").withColumn("needs_review", F.when(latest, 0).otherwise(F.col("needs_review"))).select(*discoveries.columns)


def expired(now: float, max_age_hours: float = 168) -> Column:
    """Whether a discovery is unreachable and older than the limit."""
    return (F.col("reachable") == 0) & (F.col("probed_at") < now - max_age_hours * 3600)


def cleanup(discoveries: DataFrame, now: float, max_age_hours: float = 168) -> DataFrame:
    """Discoveries without those that have expired."""
    return discoveries.where(~expired(now, max_age_hours))


def reconcile(targets: DataFrame, catalog: DataFrame, now: float) -> tuple[DataFrame, Observation]:
    """Address-book targets against a catalog of hashes: those in it get a new time, the others become stale.

    Returns the targets and an observation whose `kept` and `stale` are counted in the pass that first writes or collects
    them, without a scan of their own.
    """
    known = catalog.select(F.upper("ident_hash_hex").alias("_hash")).distinct().withColumn("_known", F.lit(True))
    x = targets.join(known, F.upper("ident_hash_hex") == F.col("_hash"), "left")
    book = F.col("source") == "addressbook"
    seen = Observation()
    x = x.observe(seen, F.count_if(book & F.col("_known").isNotNull()).alias("kept"), F.count_if(book & F.col("_known").isNull()).alias("stale"))
    return x.withColumns({
        "last_updated_at": F.when(book & F.col("_known"), F.lit(now)).otherwise(F.col("last_updated_at")),
        "source": F.when(book & F.col("_known").isNull(), F.lit(STALE_SOURCE)).otherwise(F.col("source")),
    }).select(*targets.columns), seen


def update_analysis(discoveries: DataFrame, targets: DataFrame, analyses: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Analyses (ident_hash_hex, analysis) on the rows of their hash that have none; their targets get the time."""
    one = analyses.groupBy("ident_hash_hex").agg(F.max("analysis").alias("_analysis"))
    text = F.when((F.coalesce("deep_analysis", F.lit("")) == "") & F.col("_analysis").isNotNull(), F.col("_analysis")).otherwise(F.col("deep_analysis"))
    rows = discoveries.join(one, "ident_hash_hex", "left").withColumn("deep_analysis", text).select(*discoveries.columns)
    done = targets.join(one, "ident_hash_hex", "left").withColumn("last_analyzed_at", F.when(F.col("_analysis").isNotNull() & (F.length("ident_hash_hex") >= 10), F.lit(now)).otherwise(F.col("last_analyzed_at"))).select(*targets.columns)
    return rows, done


def update_summaries(discoveries: DataFrame, summaries: DataFrame) -> DataFrame:
    """New summaries (id, content_summary) on their rows."""
    new = summaries.groupBy("id").agg(F.max("content_summary").alias("_summary"))
    return discoveries.join(new, "id", "left").withColumn("content_summary", F.coalesce("_summary", "content_summary")).select(*discoveries.columns)


def keep_last_id(discoveries: DataFrame) -> DataFrame:
    """The row with the highest id of each (ident_hash_hex, probe_mode)."""
    last = Window.partitionBy("ident_hash_hex", "probe_mode").orderBy(F.desc("id"))
    return discoveries.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
