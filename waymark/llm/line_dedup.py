"""Line dedup: two Bloom filters find the lines that may repeat; only those shuffle."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, join_skewed, plan_bytes, sent_if_small, small, small_batches, texts_of

#: Bits of a filter: by the input's size, within these bounds. The larger bound is 128 MB; beyond it more lines are
#: suspected by chance and shuffled, and the result is the same.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
SEGMENT = 1 << 16
#: Input bytes of a task that fills filters: each has two, so there are few tasks.
TASK_BYTES = 2 << 30
#: Bytes of a row of a document with the lines that it loses.
ROW_BYTES = 96
MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: bytes, least: int) -> bytes | None:
    """The stripped line with A-Z lower-cased, or None if it has fewer code points than least."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(bits - 1)


def has(filter_: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _places(h, bits):
        found &= (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def add(filter_: np.ndarray, h: np.ndarray, bits: int) -> None:
    for at in _places(h, bits):
        np.bitwise_or.at(filter_, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def _local_filters(bits: int, least: int):
    schema = pa.schema([("seg", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in small(batches):
            hashes: list[int] = []
            for text in texts_of(b.column(0)):
                hashes += map(xxhash.xxh3_64_intdigest, {k for line in text.split(b"\n") if (k := line_key(line, least))})
            h, n = np.unique(np.array(hashes, np.uint64), return_counts=True)
            again = h[(n > 1) | has(once, h, bits)]
            add(once, h, bits)
            add(twice, again, bits)
        for seg in range(-(-len(once) // SEGMENT)):
            a, b2 = once[seg * SEGMENT : (seg + 1) * SEGMENT], twice[seg * SEGMENT : (seg + 1) * SEGMENT]
            if a.any():
                yield pa.record_batch([pa.array([seg], pa.int32()), pa.array([zlib.compress(a.tobytes(), 1)]), pa.array([zlib.compress(b2.tobytes(), 1)])], schema=schema)

    return build


def _merged(batches):
    """From the segments of all local filters, sorted: seen twice is twice in one, or once in two."""
    schema = pa.schema([("seg", pa.int32()), ("twice", pa.binary())])
    now, once, twice = None, None, None

    def out():
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)])], schema=schema)

    for b in batches:
        for seg, a, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            a, t = (np.frombuffer(zlib.decompress(x), np.uint8).copy() for x in (a, t))
            if seg != now:
                if now is not None:
                    yield out()
                now, once, twice = seg, a, t
            else:
                twice |= t | (once & a)
                once |= a
    if now is not None:
        yield out()


def seen_twice(df: DataFrame, text_col: str, bits: int, least: int, size: int) -> np.ndarray:
    """A filter of bits / 8 bytes that holds each key of two or more documents (and some others). size: bytes of the texts."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES, 1)
    local = df.select(F.col(text_col).alias("text")).coalesce(tasks).mapInArrow(_local_filters(bits, least), "seg int, once binary, twice binary")
    merged = local.repartition("seg").sortWithinPartitions("seg").mapInArrow(_merged, "seg int, twice binary")
    filter_ = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        part = np.frombuffer(zlib.decompress(r.twice), np.uint8)
        filter_[r.seg * SEGMENT : r.seg * SEGMENT + len(part)] = part
    return filter_


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "smallest", bits: int | None = None) -> DataFrame:
    """Drops the lines that many documents share, except in one of them.

    A line's key is the line without ASCII space at its ends, A-Z lower-cased. Keys of min_chars code points or more,
    found in min_docs documents or more, lose all their lines except in the document with the smallest (or largest) id
    that holds them. Lines to drop are told by 64-bit hashes of their keys. Each task fills a filter of keys seen once and one of keys seen twice, in memory of a fixed size;
    merged, the second says which keys may repeat. Only those are shuffled, are counted by their full text with partial
    sums (so a line of every document is no hot spot), and give each document its list of lines to drop.

    Returns id, n_lines, n_dropped, kept_text, kept_sha256. Null and empty texts are one empty line. Each row counts as
    a document; rows that share the id that keeps a line all keep it. Null ids come last: they keep a line only where
    no other id holds it. Texts of any length are read whole. Extra columns are left out, whatever their names. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    size = plan_bytes(df)
    if size is None:  # a table that isn't from files, say
        size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (max(size // 8, 1) - 1).bit_length()))
    # the hash tells rows of one id apart, or of none
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit(2)).alias("th"))
    with small_batches(spark):
        filter_ = spark.sparkContext.broadcast(seen_twice(docs, "text", bits, min_chars, size))

    def suspects(batches):
        schema = pa.schema([("key", pa.binary()), ("h", pa.int64()), ("id", id_type), ("th", pa.int64())])
        for b in small(batches):
            keys, owners = [], []
            for row, text in enumerate(texts_of(b.column(1))):
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                keys += own
                owners += [row] * len(own)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            at = np.flatnonzero(has(filter_.value, h, bits))
            if len(at):
                own = pa.array(np.array(owners, np.int64)[at])
                yield pa.record_batch([pa.array([keys[i] for i in at], pa.binary()), pa.array(h[at].view(np.int64)), b.column(0).take(own), b.column(2).take(own)], schema=schema)

    id_name = docs.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["id"].dataType)
    with small_batches(spark):
        found = cut(docs.mapInArrow(suspects, f"key binary, h long, id {id_name}, th long"))
    pick = F.min if keep == "smallest" else F.max
    repeated = cut(found.groupBy("key").agg(F.count("*").alias("n"), pick("id").alias("keeper")).where(F.col("n") >= min_docs))
    held = join_skewed(found, repeated, "key", "n").where("n is not null")
    drops = held.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id", "th").agg(F.collect_set("h").alias("drop"))
    drops = cut(drops.select(F.col("id").alias("drop_id"), F.col("th").alias("drop_th"), "drop"))
    lines = drops.agg(F.coalesce(F.max(F.size("drop")), F.lit(0))).first()[0]
    joined = docs.join(sent_if_small(drops, ROW_BYTES + 8 * lines), (F.col("th") == F.col("drop_th")) & F.col("id").eqNullSafe(F.col("drop_id")), "left").select("id", "text", "drop")

    def apply(batches):
        schema = pa.schema([("id", id_type), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
        for b in small(batches):
            total, dropped, kept, sha = [], [], [], []
            for text, drop in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                total.append(len(lines))
                if drop:
                    gone = {x & 0xFFFFFFFFFFFFFFFF for x in drop}
                    lines = [x for x in lines if not ((k := line_key(x, min_chars)) and xxhash.xxh3_64_intdigest(k) in gone)]
                dropped.append(total[-1] - len(lines))
                kept.append(b"\n".join(lines))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], schema=schema)

    return joined.mapInArrow(apply, f"id {id_name}, n_lines long, n_dropped long, kept_text string, kept_sha256 string")
