"""Shared helpers of the training-data operators: words, hashes, checkpoints, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes that a Python worker takes up at once.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Bytes that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: From here on an estimate of a size is none.
UNKNOWN_BYTES = 1 << 55
#: Bytes that a node of a graph and its label take in a broadcast.
NODE_BYTES = 64
#: Bytes of a row besides its columns, about.
ROW_OVERHEAD = 32
#: bytes.translate table: A-Z lower-cased; other ASCII outside 0-9 and a-z becomes a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run inside get Arrow batches of BATCH_ROWS and BATCH_BYTES; the session's own settings come back after."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    held = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, BATCH_ROWS and about BATCH_BYTES at a time, for work that needs several times a text's memory."""
    for b in batches:
        step = max(1, min(BATCH_ROWS, int(b.num_rows * BATCH_BYTES / max(b.nbytes, 1))))
        for start in range(0, b.num_rows, step):
            yield b.slice(start, step)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share. Only a session on a single machine may leave it unset
    and gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="waymark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet in the shared folder and read again; and where it is."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(df: DataFrame) -> DataFrame:
    """df with rows that come in the same order whenever a task is done again, so that row numbers hold: scans do, and what
    a shuffle brought is written to the shared checkpoint folder first."""
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the size of df; for a table scan the size of its files. None where it has none, which it
    says by a size beyond all storage, or by products of that."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else None


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered for as many words as fit a bounded cache."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words; a shorter, not empty, sequence is one shingle."""
    n = min(n, len(words))
    if not n:
        return words
    count, h = len(words) - n + 1, np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
    return h


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, a checkpoint, with a broadcast hint where its counted rows take BROADCAST_BYTES at most; else with the hint to
    shuffle both sides and hash this one, so that the other isn't sorted."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_hash")


def join_skewed(rows: DataFrame, known: DataFrame, key: str, often: str) -> DataFrame:
    """rows left join known, one row for each key, where a few keys may have most of the rows.

    often: the column of known that counts a key's rows. Keys with more than a quarter of a mean task's rows are joined
    by a broadcast; there are at most four for each task. If they take more than BROADCAST_BYTES, as long texts may, only
    a key with more rows goes that way: the bound is doubled until they fit, or the join of them is left to Spark, which splits
    the tasks of hot keys. Null keys meet nothing, and aren't shuffled.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound = known.agg(F.coalesce(F.sum(often), F.lit(0))).first()[0] // (4 * tasks)
    known, rest = known.withColumnRenamed(key, "_key"), [c for c in known.columns if c != key]
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("binary")) if t in ("string", "binary") else F.lit(16), F.lit(0)) for c, t in known.dtypes]
    bytes_ = F.lit(ROW_OVERHEAD) + sum(sizes[1:], sizes[0])
    steps = [bound << i for i in range(8)]
    taken = known.where(F.col(often) > bound).agg(*[F.coalesce(F.sum(F.when(F.col(often) > s, bytes_)), F.lit(0)).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    fits = [s for s, n in zip(steps, taken, strict=True) if n <= BROADCAST_BYTES]
    bound = fits[0] if fits else bound
    hot, other = known.where(F.col(often) > bound), known.where(F.col(often) <= bound)
    hot = F.broadcast(hot) if fits else hot
    here = rows.where(F.col(key).isNotNull()).join(hot, F.col(key) == F.col("_key"), "left")
    # the rows of rare keys, and those that hot keys have settled
    late = here.where("_key is null").select(*rows.columns).join(other, F.col(key) == F.col("_key"), "left")
    nulls = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in rest])
    return here.where("_key is not null").select(*rows.columns, *rest).unionByName(late.select(*rows.columns, *rest)).unionByName(nulls)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) over longs: (node, label), label the smallest node.

    Contraction: each node goes to the smallest of itself and its neighbours, then on to where that went, and edges join
    what their ends went to, until none is left. Edges shrink by a factor each round, so rounds grow as the logarithm of
    the longest path, and the rounds' steps, put together from the last to the first, take about as much as the first
    alone. Rounds are cut by checkpoints. Nodes and links stay distributed. Where a node has very many edges, they are
    joined where they lie if the table of nodes is small, and else by a shuffle that adaptive execution splits.
    """
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not steps or edges.limit(1).count():
        near = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
        step = cut(near.join(sent_if_small(near.toDF("label", "far"), NODE_BYTES), "label").select("node", F.col("far").alias("label")))
        steps.append(step)
        ends = edges.join(sent_if_small(step.toDF("a", "x"), NODE_BYTES), "a").join(sent_if_small(step.toDF("b", "y"), NODE_BYTES), "b")
        edges = cut(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    found = steps.pop()
    while steps:
        later = sent_if_small(found.toDF("label", "end"), NODE_BYTES)
        found = cut(steps.pop().join(later, "label", "left").select("node", F.coalesce("end", "label").alias("label")))
    return found
