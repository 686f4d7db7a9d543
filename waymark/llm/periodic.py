"""Periodic runs of words: a suffix automaton whose end positions are merged small to large."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix, small, texts_of

#: A run has at least this many words, and at least so many periods.
LEAST, PERIODS = 6, 4
#: Words of a piece by which stretches that may hold a run are found.
PIECE = 4
#: A merge of as many positions sorts both sets anew; fewer are put in one by one.
MANY = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Numbers(dict):
    """A number for each word, as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def stretches(words: np.ndarray, docs: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of stretches of words that may hold a run; every run lies within one of them.

    words, docs: the numbers of all words of a batch and of their documents. In a run of PERIODS periods q or more, each
    piece of PIECE words is found again at most q words away, and there are at least PERIODS * q - PIECE + 1 pieces in a
    row. So a piece counts only if it is found again within that bound for the row of such pieces it lies in; rows
    shrink until nothing changes. Equal pieces always have equal hashes, so a collision only adds work.
    """
    n = len(words) - PIECE + 1
    if n < 1:
        return []
    h = mix(docs[:n].astype(np.uint64) + np.uint64(1))
    for i in range(PIECE):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n].astype(np.uint64))
    # a piece over the end of a document is like no other
    h = np.where(docs[:n] == docs[PIECE - 1 :], h, np.arange(n, dtype=np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    near, gap = np.full(n, n + 1), np.diff(order)
    near[order[1:][same]] = gap[same]
    near[order[:-1][same]] = np.minimum(near[order[:-1][same]], gap[same])
    near[:-1][docs[: n - 1] != docs[PIECE - 1 : n + PIECE - 2]] = n + 1
    at = np.flatnonzero(near <= n)
    while True:
        breaks = np.flatnonzero(np.diff(at) != 1) + 1 if len(at) else np.zeros(0, np.int64)
        edges = np.r_[0, breaks, len(at)]
        length = np.diff(edges)
        row = np.repeat(length, length)
        keep = (near[at] * PERIODS <= row + PIECE - 1) & (row + PIECE - 1 >= LEAST)
        if keep.all():
            return [(int(at[a]), int(at[b - 1]) + PIECE) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        at = at[keep]


def automaton(w: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of w: for each state its longest length, its suffix link, and the end position of the prefix that
    made it (-1 for the root and for clones)."""
    step: list[dict[int, int]] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(step)
        step.append({})
        length.append(i + 1)
        link.append(0)
        end.append(i)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                link[q] = link[new] = clone
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = new
    return length, link, end


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many items from the start on are alike."""
    n, at, block = min(len(a), len(b)), 0, 32
    while at < n:
        differ = np.flatnonzero(a[at : min(at + block, n)] != b[at : min(at + block, n)])
        if len(differ):
            return at + int(differ[0])
        at, block = at + block, block * 4
    return n


def runs_of(words: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Every run (start, length, period) of a stretch, in order.

    States are taken from the longest to the shortest, and each gives its end positions to its suffix link, the smaller set
    to the larger one. Two positions that become neighbours at a state whose longest string is not shorter than their
    distance end a square of that period, and no smaller one: had the square a smaller period, a third position would lie
    between them. Both ends of every run meet in this way, so each run has a seed; a seed is extended once.
    """
    w = words.tolist()
    n = len(w)
    length, link, end = automaton(w)
    held: list[list[int] | None] = [[n - 1 - e] if e >= 0 else [] for e in end]  # from the end, as prefixes come first
    known: dict[int, list[tuple[int, int]]] = {}
    out = []

    def seed(p: int, q: int) -> None:
        """A square of period q whose last word is p."""
        own = known.setdefault(q, [])
        i = bisect_left(own, (p - 2 * q + 2,)) - 1
        if i >= 0 and own[i][1] > p:
            return
        stop = p + 1 + reach(words[p + 1 :], words[p + 1 - q :])
        start = p - q + 1 - reach(words[p - q :: -1], words[p::-1]) if p >= q else p - q + 1
        own.insert(bisect_left(own, (start,)), (start, stop))
        if stop - start >= max(least, periods * q):
            out.append((start, stop - start, q))

    for s in np.argsort(-np.array(length), kind="stable").tolist()[:-1]:
        up = link[s]
        large, few, most = held[up], held[s], length[up]
        held[s] = None
        if len(large) < len(few):
            large, few = few, large
        if len(few) >= MANY:
            large = sorted(large + few)
        else:
            for x in few:
                i = bisect_left(large, x)
                large.insert(i, x)
        if most:
            for x in few:
                i = bisect_left(large, x)
                if i and x - large[i - 1] <= most:
                    seed(n - 1 - large[i - 1], x - large[i - 1])
                if i + 1 < len(large) and large[i + 1] - x <= most:
                    seed(n - 1 - x, large[i + 1] - x)
        held[up] = large
    return sorted((s, size, q) for s, size, q in out)


def collapse(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Which of so many words stay: those that no run holds after its first period. None if all do."""
    if not runs:
        return None
    keep = np.ones(count, bool)
    for start, size, q in runs:
        keep[start + q : start + size] = False
    return keep


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of words that repeat themselves, in each whole text, and the text with each of them cut to one period.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of smallest period q and at least LEAST words and PERIODS * q words
    that can't be made longer. Most texts have no stretch that may hold one, which hashes of short pieces tell for a
    whole batch; the others' stretches go to a suffix automaton. That takes some 600 bytes a word of a stretch, so a
    text that repeats itself over 10^6 words takes 600 MB of a worker.

    Returns id, n_words, runs (start, length, period; in order of start, then period) and collapsed, the words that stay
    joined by one space. Null and empty texts have no words, no runs and an empty text. Each input row gives one row,
    repeated rows too; extra columns are left out, whatever their names; an empty table gives none. Work is by row, so
    hot keys play no part.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    name, id_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            split, numbers = [WORD.findall(t) for t in texts_of(b.column(1))], Numbers()
            sizes = np.array([len(s) for s in split], np.int64)
            ends = np.cumsum(sizes)
            words = np.fromiter((numbers[x] for s in split for x in s), np.int64, int(ends[-1]) if len(ends) else 0)
            found: list[list[tuple[int, int, int]]] = [[] for _ in split]
            for a, z in stretches(words, np.repeat(np.arange(len(split)), sizes)):
                d = int(np.searchsorted(ends, a, "right"))
                first = a - int(ends[d] - sizes[d])
                found[d] += [(first + start, size, q) for start, size, q in runs_of(words[a:z])]
            kept = []
            for s, r in zip(split, found, strict=True):
                r.sort(key=lambda x: (x[0], x[2]))
                k = collapse(len(s), r)
                kept.append(b" ".join(s if k is None else [x for x, stays in zip(s, k.tolist(), strict=True) if stays]))
            runs = pa.array([[{"start": s, "length": size, "period": q} for s, size, q in r] for r in found], schema.field("runs").type)
            yield pa.record_batch([b.column(0), pa.array(sizes), runs, pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return docs.mapInArrow(work, f"id {name}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
