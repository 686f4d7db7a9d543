"""Benchmark decontamination by a prefix-filtered join of word windows."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD_TABLE, cut, mix, small, small_batches, texts_of

WINDOW, SHINGLE = 10, 3
#: Words of benchmark text that one block has: what is broadcast at once. Larger benchmarks go block by block.
BLOCK_WORDS = 1_000_000
#: Bits of a word's number in a block; so a shingle of at most three words is one whole number.
WORD_BITS = 21
_BITS = 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Vocabulary(dict):
    """Numbers, from 1, of the words of a block of the benchmark; other words are 0 and in no shingle."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(0)), np.int64, len(words))


def shingles(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words, 0 if one of them isn't in the vocabulary."""
    count = max(len(numbers) - n + 1, 0)
    code, known = numbers[:count].copy(), numbers[:count] > 0
    for i in range(1, n):
        part = numbers[i : i + count]
        code, known = code << WORD_BITS | part, known & (part > 0)
    return np.where(known, code, 0)


class _Marks:
    """Places of known shingles in a text: a bitmap first, then a binary search."""

    def __init__(self, codes):
        self.codes = np.array(sorted(codes), np.int64)
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return mix(codes.view(np.uint64)) >> np.uint64(64 - _BITS)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of the shingles there)."""
        at = np.flatnonzero(codes)
        at = at[self.map[self._slot(codes[at])]]
        k = np.searchsorted(self.codes, codes[at])
        found = (k < len(self.codes)) & (self.codes[np.minimum(k, max(len(self.codes) - 1, 0))] == codes[at]) if len(self.codes) else np.zeros(len(at), bool)
        return at[found], k[found]


def _windows(items: list[tuple[str, list[bytes]]], size: int) -> list[tuple[str, tuple[bytes, ...]]]:
    return [(name, tuple(w[i : i + size])) for name, w in items for i in range(max(1, len(w) - size + 1)) if w]


def _count(sent):
    """Documents that hold each of the benchmark's shingles, counted a task at a time."""

    def run(batches):
        vocabulary, known = sent.value
        marks = {n: _Marks(codes) for n, codes in known.items()}
        seen = {n: np.zeros(len(m.codes), np.int64) for n, m in marks.items()}
        for b in small(batches):
            for text in texts_of(b.column(0)):
                numbers = vocabulary.of(words_of(text))
                for n, mark in marks.items():
                    seen[n][np.unique(mark.find(shingles(numbers, n))[1])] += 1
        for n, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.full(len(at), n, np.int32)), pa.array(marks[n].codes[at]), pa.array(counts[at])], names=["length", "shingle", "n"])

    return run


def _search(sent, id_type: pa.DataType):
    """The words that windows cover and the items whose windows occur, for each document.

    sent: the vocabulary, and for each length of prefix its shingles with [(place in the window, window, item ids)].
    """
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches):
        vocabulary, prefixes = sent.value
        marks = {n: _Marks(ways) for n, ways in prefixes.items()}
        ways_of = {n: [prefixes[n][int(c)] for c in m.codes] for n, m in marks.items()}
        for b in small(batches):
            total, spans, items = [], [], []
            for text in texts_of(b.column(1)):
                words, covered, hit = words_of(text), [], set()
                numbers = vocabulary.of(words)
                for n, mark in marks.items():
                    for i, k in zip(*map(np.ndarray.tolist, mark.find(shingles(numbers, n))), strict=True):
                        for at, window, names in ways_of[n][k]:
                            # bounds on place and length, then the window itself
                            start = i - at
                            if start >= 0 and start + len(window) <= len(words) and tuple(words[start : start + len(window)]) == window:
                                covered.append((start, start + len(window)))
                                hit.update(names)
                total.append(len(words))
                flat: list[int] = []
                for a, z in sorted(covered):
                    if flat and a <= flat[-1]:
                        flat[-1] = max(flat[-1], z)
                    else:
                        flat += [a, z]
                spans.append(flat)
                items.append(sorted(hit))
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(items, schema.field("items").type)], schema=schema)

    return run


def _finish(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("items_sha256", pa.string())])

    def run(batches):
        for b in small(batches):
            spans, items, hit = [], [], []
            for parts, names in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                flat: list[int] = []
                for a, z in sorted((p[i], p[i + 1]) for p in parts for i in range(0, len(p), 2)):
                    if flat and a <= flat[-1]:
                        flat[-1] = max(flat[-1], z)
                    else:
                        flat += [a, z]
                spans.append(flat)
                hit.append(sum(flat[1::2]) - sum(flat[::2]))
                items.append(sorted({x for name in names for x in name}))
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(items, schema.field("items").type), pa.array(sha)], schema=schema)

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null").toLocalIterator():
        words = words_of(r.text.encode("utf-8", "replace"))
        if words:
            block.append((r.id, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The benchmark windows that occur in each document, by a prefix-filtered join.

    Words are runs of digits, letters and other non-ASCII characters, A-Z lower-cased. A window is `window` consecutive
    words of an item; a shorter item is one window. A window lies in a document only if its rarest word shingle does:
    one pass over all documents counts the documents of every benchmark shingle, each window keeps the rarest of its
    own as its prefix, and the second pass looks up only prefixes, bounds the window's place and length, and compares
    the words themselves. The benchmark is a stated query set and goes in blocks of block_words words, so what is
    broadcast has that bound; with several blocks the spans of a document are joined up afterwards.

    Returns id, n_words, n_hit (words inside any window that occurs), spans (word offsets, start and end by turns),
    items and items_sha256 (of their comma-joined sorted names). A null or empty text has no words. Null items and null
    item ids are left out. Repeated items count once. Every input row gives one row; with several blocks, rows are told
    apart by their id and text. An empty benchmark gives no hits.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_name = docs.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["id"].dataType)
    if not 1 <= shingle <= 3:
        raise ValueError("a shingle has one to three words")
    parts = []
    shape = f"id {id_name}, n_words long, spans array<long>, items array<string>"
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    many = second is not None

    def chain():
        yield first
        if many:
            yield second
            yield from blocks

    for block in chain():
        holders: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for name, w in _windows(block, window):
            holders[w].add(name)
        vocabulary = Vocabulary({w: i for i, w in enumerate(sorted({w for ws in holders for w in ws}), 1)})
        inner = {w: shingles(vocabulary.of(list(w)), min(shingle, len(w))).tolist() for w in holders}
        known: dict[int, set[int]] = defaultdict(set)
        for w, codes in inner.items():
            known[min(shingle, len(w))].update(codes)
        sent = spark.sparkContext.broadcast((vocabulary, dict(known)))
        sums = docs.select("text").mapInArrow(_count(sent), "length int, shingle long, n long").groupBy("length", "shingle").agg(F.sum("n").alias("n"))
        with small_batches(spark):
            counts = {(r.length, r.shingle): r.n for r in sums.collect()} if known else {}  # one row for each shingle of the block at most
        prefixes: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for w, codes in inner.items():
            n = min(shingle, len(w))
            at = min(range(len(codes)), key=lambda i: (counts.get((n, codes[i]), 0), i))
            if counts.get((n, codes[at]), 0):
                prefixes[n][codes[at]].append((at, w, sorted(holders[w])))
        sent = spark.sparkContext.broadcast((vocabulary, {n: dict(x) for n, x in prefixes.items()}))
        if not many:
            parts.append(docs.mapInArrow(_search(sent, id_type), shape))
        else:
            flat = docs.select(F.to_json(F.struct(F.col("id").cast("string").alias("i"), F.xxhash64("text", F.lit(1)).alias("h"))).alias("id"), "text")
            parts.append(cut(flat.mapInArrow(_search(sent, pa.string()), shape.replace(f"id {id_name}", "id string", 1))))
    if not many:
        found = parts[0].select("id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:
        every = parts[0].select("id", "n_words", "spans", "items", F.lit(0).alias("b"))
        for b, p in enumerate(parts[1:], 1):
            every = every.union(p.select("id", "n_words", "spans", "items", F.lit(b).alias("b")))
        # documents without hits come from the first block alone; rows that are alike in id and text are counted there
        hits = every.where(F.size("items") > 0).groupBy("id").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
        found = parts[0].select("id", "n_words").join(hits, "id", "left").select(
            F.get_json_object("id", "$.i").cast(id_name).alias("id"), "n_words",
            F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<array<string>>")).alias("items"),
        )
    return found.mapInArrow(_finish(id_type), f"id {id_name}, n_words long, n_hit long, spans array<long>, items array<string>, items_sha256 string")
