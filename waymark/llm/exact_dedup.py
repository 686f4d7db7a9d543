"""Exact dedup by content sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settled

#: A splitter key: the first bytes of the text, its SHA-256 and two bytes that spread the copies of one text.
PREFIX, KEY = 64, 64 + 32 + 2
SAMPLE_PER_BUCKET, MAX_BUCKETS = 24, 20_000


def _start(text):
    return F.rpad(F.substring(text.cast("binary"), 1, PREFIX), PREFIX, F.unhex(F.lit("00")))


def _key(text, place):
    # by the number of the row, not by its id, which null ids and repeated rows share
    salt = F.substring(F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(place), F.lit(65536))), 4, "0")), 1, 2)
    return F.concat(_start(text), F.unhex(F.sha2(text.cast("binary"), 256)), salt)


def splitters(df: DataFrame, key, buckets: int) -> list[bytes]:
    """Quantiles of a sample of the sort keys: about SAMPLE_PER_BUCKET * buckets keys of 98 bytes reach the driver."""
    share = min(1.0, SAMPLE_PER_BUCKET * buckets / max(df.count(), 1))
    sample = sorted(bytes(r.key) for r in df.sample(share, seed=7).select(key.alias("key")).collect())
    return sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: bool = False, buckets: int | None = None) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z; one row of each group stays.

    Sampled splitters cut the order of (text, salt of the row) into ranges; each range is sorted outside memory by its
    whole normalised text, and neighbours are compared in full. A text with so many copies that a splitter falls inside
    it lies in several ranges; only those texts (at most one for each splitter) are joined up again, by their SHA-256,
    in sums of one row per range. keep: "smallest" or "largest" identifier.

    Returns id, keep_id, group_size, kept, text_sha256 and, with carry, `row`, a struct of the whole input row, so that
    extra columns of any name do no harm. Null and empty texts are equal. A null id is never preferred. Of repeated
    rows with the id that stays, exactly one is kept. An empty table gives no rows.
    """
    spark, df = df.sparkSession, settled(df)
    text, place = ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.monotonically_increasing_id()
    plain = df.select(F.col(id_col).alias("id"), place.alias("place"), text.alias("norm"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []))
    keyed = plain.withColumn("key", _key(F.col("norm"), F.col("place")))
    buckets = min(MAX_BUCKETS, buckets or 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(df, _key(text, place), buckets)
    blob, steps = b"".join(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    # a binary search in the sorted splitters, which are one literal of fixed-width keys
    bucket = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when((at + step <= len(cuts)) & (F.substring(F.lit(blob), (at + step - 1) * KEY + 1, F.lit(KEY)) <= F.col("key")), at + step).otherwise(at),
    ) if cuts else F.lit(0)
    placed = keyed.withColumn("bucket", bucket).withColumn("sha", F.substring("key", PREFIX + 1, 32)).drop("key").repartition("bucket")
    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    near = Window.partitionBy("bucket", "norm").orderBy(best)
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = placed.select("id", "place", *(["row"] if carry else []), "sha", F.first("id").over(whole).alias("own_keep"), F.count("*").over(whole).alias("own_size"), F.row_number().over(near).alias("rn"))
    torn = sorted({k[PREFIX : PREFIX + 32] for k in cuts})
    if torn:
        # one row for each text that a splitter touches, so never more rows than splitters
        is_torn = spark.createDataFrame([(bytearray(k),) for k in torn], "sha binary")
        starts = spark.createDataFrame([(bytearray(k),) for k in sorted({k[:PREFIX] for k in cuts})], "start binary")
        best_row = F.min(F.struct(F.col("id").isNull(), "id", "place")) if keep == "smallest" else F.max(F.struct(F.col("id").isNotNull(), "id", "place"))
        # the start, from the first characters alone, leaves few texts whose digest is needed
        start = _start(ascii_lower(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, PREFIX)))
        alike = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), start.alias("start"), place.alias("place")).join(F.broadcast(starts), "start", "left_semi")
        alike = alike.select("id", "place", F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)).alias("sha"))
        totals = alike.join(F.broadcast(is_torn), "sha", "left_semi").groupBy("sha").agg(best_row.alias("best"), F.count("*").alias("all_size"))
        totals = totals.select("sha", F.col("best.id").alias("all_keep"), F.col("best.place").alias("all_place"), "all_size")
        found = found.join(F.broadcast(totals), "sha", "left")
    else:
        found = found.withColumn("all_keep", F.col("own_keep")).withColumn("all_place", F.col("place")).withColumn("all_size", F.lit(None).cast("long"))
    keep_id = F.when(F.col("all_size").isNull(), F.col("own_keep")).otherwise(F.col("all_keep"))
    return found.select(
        "id", keep_id.alias("keep_id"), F.coalesce("all_size", "own_size").alias("group_size"),
        F.when(F.col("all_size").isNull(), F.col("rn") == 1).otherwise(F.col("place") == F.col("all_place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *(["row"] if carry else []),
    )
