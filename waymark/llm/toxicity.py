"""Toxicity by a linear-chain conditional random field over words."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small
from .training import labelled_sample, logistic, share_of_ones, sigmoid, train, unlike

PER_LABEL, ROUNDS = 1000, 25
WORD = re.compile(r"\w+")
#: Lengths of the word starts that are features beside the whole word.
STARTS = (4, 5, 6)
#: Words that a lane of the chain runs.
LANE = 64
_CACHE = 200_000


def names_of(word: str) -> list[str]:
    w = word.lower()
    return [f"={w}", *(f"{k}{w[:k]}" for k in STARTS if len(w) >= k)]


def toxic_words(words: list[list[str]], toxic: np.ndarray) -> set[str]:
    """The words that label a toxic document's tokens: found in toxic documents more often than chance allows.

    A feature is telling if its share of toxic documents is over 8 times that of clean ones, and G squared is beyond
    1.3 times the log of the number of features. A word is toxic if one of its features is telling and its longest
    feature of three documents or more isn't as common in clean ones.
    """
    n = [Counter(), Counter()]
    for ws, y in zip(words, toxic, strict=True):
        n[y].update({x for w in set(ws) for x in names_of(w)})
    most = [max(int((toxic == y).sum()), 1) for y in (0, 1)]
    bound = 1.3 * math.log(max(len(n[1]), 2))

    def part(k: int, m: int, share: float) -> float:
        return (k * math.log(k / m / share) if k else 0.0) + ((m - k) * math.log((m - k) / m / (1 - share)) if k < m and share < 1 else 0.0)

    def apart(x: str) -> bool:
        return n[1][x] / most[1] > 8 * n[0][x] / most[0]

    def telling(x: str) -> bool:
        share = (n[0][x] + n[1][x]) / sum(most)
        return n[1][x] > 2 and apart(x) and 2 * (part(n[1][x], most[1], share) + part(n[0][x], most[0], share)) > bound

    marks, found = {x for x in n[1] if telling(x)}, set()
    for w in {w for ws, y in zip(words, toxic, strict=True) if y for w in ws}:
        names = names_of(w)
        if any(x in marks for x in names):
            longest = next((x for x in (names[0], *reversed(names[1:])) if n[0][x] + n[1][x] >= 3), names[0])
            if apart(longest):
                found.add(w)
    return found


def _run(emit: np.ndarray, new: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """Odds x[k] = emit[k] * (start if new[k], else (t01 + t11 * x[k - 1]) / (t00 + t10 * x[k - 1])).

    The chain runs in parallel lanes. Each lane first runs as a product of 2 x 2 steps, which maps the odds before it to
    those at its end; a walk over the lanes then gives each its start, and the lanes run again from there.
    """
    size = len(emit)
    lanes = -(-size // LANE)
    e, begins = np.ones(lanes * LANE), np.zeros(lanes * LANE, bool)
    e[:size], begins[:size] = emit, new
    e, begins = e.reshape(lanes, LANE), begins.reshape(lanes, LANE)
    (a00, a01), (a10, a11) = trans
    # odds are top / bottom of these two; p: factors of the odds before the lane, q: what doesn't depend on them
    top_p, top_q, low_p, low_q = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(LANE):
        w, b = e[:, t], begins[:, t]
        tp, lp = w * (a11 * top_p + a01 * low_p), a10 * top_p + a00 * low_p
        tq, lq = w * (a11 * top_q + a01 * low_q), a10 * top_q + a00 * low_q
        # at a document's edge the odds before don't count
        top_p, low_p, top_q, low_q = np.where(b, 0.0, tp), np.where(b, 0.0, lp), np.where(b, w * start, tq), np.where(b, 1.0, lq)
        scale = np.maximum(np.maximum(top_p, top_q), np.maximum(low_p, low_q))
        top_p, top_q, low_p, low_q = top_p / scale, top_q / scale, low_p / scale, low_q / scale
    r, x = np.empty(lanes), start
    for k, (tp, tq, lp, lq) in enumerate(zip(top_p.tolist(), top_q.tolist(), low_p.tolist(), low_q.tolist(), strict=True)):
        r[k] = x
        x = (tp * x + tq) / (lp * x + lq)
    out = np.empty((lanes, LANE))
    for t in range(LANE):
        r = e[:, t] * np.where(begins[:, t], start, (a01 + a11 * r) / (a00 + a10 * r))
        out[:, t] = r
    return out.reshape(-1)[:size]


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Odds of toxic to clean of the forward and the backward messages, at each word of all documents in a row.

    emit: factors of the toxic state (1 for clean); first: marks the first word of each document; trans: 2 x 2 factors.
    Messages are of the whole document, wherever it lies in the row; at a document's edge a message starts anew.
    """
    ahead = _run(emit, first, trans, start)
    last = np.r_[first[1:], True] if len(emit) else first
    # backwards, the odds with the word's own factor follow the chain of the turned transitions
    held = _run(emit[::-1], last[::-1], np.array([[trans[0, 0], trans[1, 0]], [trans[0, 1], trans[1, 1]]]), 1.0)[::-1]
    return ahead, held / emit


class Model:
    """The field, trained on words labelled by the documents' labels, and a logistic fit of document scores.

    In toxic documents the words that `toxic_words` finds are labelled toxic; all other words are clean. Weights
    are those of hashed features, of the transitions and of the start; AdaGrad climbs the penalised likelihood.
    """

    def __init__(self, sample: list[tuple[str, int]], counts: dict[int, int]):
        y = np.array([int(bool(label)) for _, label in sample], np.int64)
        self.prior, self.weights = (share_of_ones(counts)), None
        if len(set(y)) < 2:
            return
        alone = unlike([t.encode("utf-8", "replace") for t, _ in sample])
        kept = [(t, k) for (t, k), a in zip(sample, alone, strict=True) if a]
        if len({int(bool(k)) for _, k in kept}) == 2:
            sample, y = kept, np.array([int(bool(k)) for _, k in kept], np.int64)
        words = [WORD.findall(t) for t, _ in sample]
        marks = toxic_words(words, y)
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        slot: dict[str, int] = {}
        flat, owner = array("q"), array("q")
        for i, w in enumerate(vocabulary):
            for x in names_of(w):
                flat.append(slot.setdefault(x, len(slot)))
                owner.append(i)
        flat, owner, size = np.array(flat), np.array(owner), len(vocabulary)
        told = np.array([w in marks for w in vocabulary], bool)
        word = np.array([vocabulary[w] for ws in words for w in ws], np.int64)
        word = word.astype(np.int32)
        doc = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        label = told[word] & (y[doc] == 1)
        u, g_u = np.zeros(len(slot)), np.full(len(slot), 1e-6)
        c, g_c = np.array([0.0, -3.0, 0.0, 0.0, -3.0]), np.full(5, 1e-6)  # log factors of 00, 01, 10, 11 and the start
        follow = ~first[1:]
        pair = 2 * label[:-1].astype(int) + label[1:]
        seen = np.array([((pair == k) & follow).sum() for k in range(4)], float)
        for _ in range(ROUNDS):
            emit = np.exp(np.clip(np.bincount(owner, u[flat], size), -15, 15))[word]
            trans = np.exp(c[:4]).reshape(2, 2)
            ahead, back = forward_backward(emit, first, trans, math.exp(c[4]))
            p = ahead * back / (1 + ahead * back)
            grad = np.bincount(word, label - p, size)
            step = np.bincount(flat, grad[owner], len(slot)) - 0.05 * u
            j = np.stack([np.ones(len(word) - 1) * trans[0, 0], trans[0, 1] * emit[1:] * back[1:], ahead[:-1] * trans[1, 0], ahead[:-1] * trans[1, 1] * emit[1:] * back[1:]])
            j = (j / j.sum(0))[:, follow].sum(1)
            move = np.r_[seen - j, (label - p)[first].sum()] - 0.05 * c
            g_u += step * step
            g_c += move * move
            u += 0.5 * step / np.sqrt(g_u)
            c += 0.2 * move / np.sqrt(g_c)
        self.weight = {x: round(float(u[i]), 4) for x, i in slot.items() if abs(u[i]) > 1e-3}
        self.trans, self.start = np.exp(c[:4]).reshape(2, 2), math.exp(c[4])
        x = np.array([self.summary(p) for p in self.marginals(words, {})])
        self.weights = logistic(x, y, 1e-2, self.prior)

    def factor(self, word: str) -> float:
        get = self.weight.get
        return math.exp(min(15.0, max(-15.0, sum([get(x, 0.0) for x in names_of(word)]))))

    def marginals(self, docs: list[list[str]], cache: dict[str, float]) -> list[np.ndarray]:
        """The probability that each word is toxic, for each document; cache keeps the words' factors."""
        sizes = [len(ws) for ws in docs]
        if not sum(sizes):
            return [np.zeros(0) for _ in docs]
        if len(cache) > _CACHE:
            cache.clear()
        emit = np.fromiter((cache.get(w) or cache.setdefault(w, self.factor(w)) for ws in docs for w in ws), float, sum(sizes))
        ends = np.cumsum(sizes)
        first = np.zeros(len(emit), bool)
        first[[e - s for e, s in zip(ends, sizes, strict=True) if s]] = True
        ahead, back = forward_backward(emit, first, self.trans, self.start)
        return np.split(ahead * back / (1 + ahead * back), ends[:-1])

    @staticmethod
    def summary(p: np.ndarray) -> tuple[float, float]:
        return (math.log1p(float(p.sum())), float(p.max())) if len(p) else (0.0, 0.0)


def tag_toxicity(df: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """Toxic spans and a document score for each whole text: id, score (0 to 1), predicted, spans.

    A linear-chain conditional random field, learned from about per_label usable documents of each label (a bounded
    sample, drawn by a hash of the id), tags words. The marginals of the forward-backward pass add up to the document's
    score, through a logistic fit of their sum and their maximum. spans holds start, end (in code points) and the
    largest marginal of each run of words at 0.5 or more. A null or empty text has no span and the score of a text
    without toxic words. With labels of one kind only, or none, every score is the share of label 1. usable: a condition
    on the column `id`.
    """
    model = train(Model, *labelled_sample(df, labels, id_col, text_col, label_col, F.lit(True) if usable is None else usable, per_label))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name, id_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = pa.schema([("id", id_type), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(span))])

    def spans_of(text: str, p: np.ndarray) -> list[dict]:
        found, places = [], None
        for i in np.flatnonzero(p >= 0.5).tolist():
            places = places or [m.span() for m in WORD.finditer(text)]
            if found and found[-1]["last"] == i - 1:
                found[-1] |= {"end": places[i][1], "last": i, "score": max(found[-1]["score"], float(p[i]))}
            else:
                found.append({"start": places[i][0], "end": places[i][1], "last": i, "score": float(p[i])})
        return [{k: s[k] for k in ("start", "end", "score")} for s in found]

    def run(batches):
        m, cache = model.value, {}
        for b in small(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            if m.weights is None:
                score, spans = np.full(len(texts), m.prior), [[] for _ in texts]
            else:
                ps = m.marginals([WORD.findall(t) for t in texts], cache)
                x = np.array([m.summary(p) for p in ps]).reshape(-1, 2)
                score = sigmoid(x @ m.weights[:-1] + m.weights[-1])
                spans = [spans_of(t, p) for t, p in zip(texts, ps, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, schema.field("spans").type)], schema=schema)

    return docs.mapInArrow(run, f"id {name}, score double, predicted int, spans array<struct<start:int,end:int,score:double>>")
