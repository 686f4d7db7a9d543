"""Bounded samples of labelled rows, and training on them in one task."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that a sample may have; more is an error, not a cut.
MOST_LABELS = 1000
#: Bytes of a text that may be learned from; longer ones are left out of samples (not of what is predicted).
MOST_BYTES = 1 << 18
_UNITS = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, label_col: str, usable: Column, per_label: int, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, dict]:
    """(id, text, label) of about per_label rows of each label, drawn by a hash among usable rows; and each label's count.

    Counts are of all usable rows; the share of each label is per_label over its count. Repeated rows are drawn once, of
    what is drawn at most twice per_label rows a label stay, those of least hash, and texts have at most most_bytes bytes:
    the sample is bounded by these parameters and the number of labels, and is the same in each run. labels: a table of
    (id, label) where the label isn't a column of docs; an id with several labels takes the largest, and the hash is of
    the id. Else the hash is of id and text. Null labels, ids and texts don't count.
    """
    text = F.when(F.octet_length(text_col) <= most_bytes, F.col(text_col))
    if labels is None:
        own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(label_col).alias("label"))
    else:
        own = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    own = own.where(F.col("label").isNotNull() & F.col("id").isNotNull() & usable)
    counts = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.lit(None).cast("string").alias("label")).limit(0), {}
    share = F.create_map(*[F.lit(x) for label, n in sorted(counts.items()) for x in (label, int(_UNITS * min(1.0, per_label / n)))])
    draw, most = F.pmod(F.xxhash64(*own.columns[:-1], F.lit(5)), F.lit(_UNITS)), 2 * per_label * len(counts)
    drawn = own.withColumn("draw", draw).where(F.col("draw") < share[F.col("label")])
    if labels is not None:
        # ids are distinct here, so that the bound is a bound on what is broadcast
        few = F.broadcast(drawn.orderBy("draw", "id").limit(most))
        drawn = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(few, "id")
    drawn = drawn.where("text is not null").withColumn("h", F.xxhash64("text"))
    return drawn.dropDuplicates(["id", "label", "h"]).orderBy("draw", "id", "h").limit(most).select("id", "text", "label"), counts


def train(build, sample: DataFrame, counts: dict) -> Trained:
    """build(rows, counts) on the (text, label) rows of a bounded sample, in one task, so that the driver needs no memory
    for it and a lost executor's training is done again. The driver gets the pickled model alone and broadcasts it."""

    def run(batches):
        rows = [(str(i), t, label) for b in batches for i, t, label in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r[0]), r[1]))
        model = build([(t, label) for _, t, label in rows], counts)
        yield pa.record_batch([pa.array([cloudpickle.dumps(model)], pa.large_binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return Trained(sample.sparkSession.sparkContext.broadcast(bytes(row.model) if row else cloudpickle.dumps(build([], counts))))


class Trained:
    """A broadcast model; each worker process unpickles it once."""

    _held: dict = {}

    def __init__(self, sent):
        self.sent = sent

    @property
    def value(self):
        data = self.sent.value
        if hash(data) not in Trained._held:
            Trained._held.clear()
            Trained._held[hash(data)] = pickle.loads(data)
        return Trained._held[hash(data)]


def unlike(texts: list[bytes]) -> np.ndarray:
    """True for each text that shares fewer than two of four least shingle hashes with those before it."""
    seen: set[tuple[int, int]] = set()
    kept = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        words = text.split()
        h = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[k : k + 4])) for k in range(max(1, len(words) - 3))], np.uint64)
        marks = {(m, int((h ^ np.uint64(0x9E3779B97F4A7C15 * (m + 1) & (1 << 64) - 1)).min())) for m in range(4)}
        kept[i] = len(marks & seen) < 2
        seen |= marks
    return kept


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, share: float | None = None) -> np.ndarray:
    """Weights of a logistic regression, the last for the constant, by damped Newton steps; rows count so that those
    with y = 1 make up the given share, as they do outside the sample."""
    each = np.ones(len(y)) if share is None else np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + l2 * w
        h = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def share_of_ones(counts: dict) -> float:
    return sum(n for k, n in counts.items() if k) / max(sum(counts.values()), 1)
