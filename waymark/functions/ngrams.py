"""Language detection by a multinomial model of character n-grams, counted by Spark."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .seeds import TEXTS

#: Characters of a body that are looked at; shorter texts are English; log-probabilities that mean sure and likely.
BODY, SHORT, SURE, LIKELY = 8192, 30, -50.0, -20.0
#: n-grams have up to so many characters; beside them each character gives the block of 256 code points it is of.
LONGEST = 3
#: n-grams that a model keeps, the most frequent over all languages; and texts of a language that it learns from.
KEPT, PER_LANGUAGE = 50_000, 200
PLACE, BLOCK = np.uint64(21), np.uint64(1 << 63)


def tidy(title: Column, body: Column) -> Column:
    """Title and body in lower case, each stretch of white space one blank."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, BODY))
    return F.lower(F.trim(F.regexp_replace(both, r"\s+", " ")))


def codes(text: str) -> np.ndarray:
    """A number for each n-gram of a text, and for the block of each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, gram = [BLOCK | (c >> np.uint64(8))], np.zeros(len(c), np.uint64)
    for n in range(LONGEST):
        gram = gram[: len(c) - n] | (c[n:] + np.uint64(1)) << (PLACE * np.uint64(n))
        out.append(gram)
    return np.concatenate(out)


def code_of(gram: str) -> int:
    """The number of an n-gram, or of a block, which is written `#` and its number."""
    if len(gram) > LONGEST:
        return int(BLOCK) | int(gram[LONGEST:])
    return sum((ord(x) + 1) << (int(PLACE) * i) for i, x in enumerate(gram))


@dataclass
class Model:
    """Log-probabilities of n-grams by language, with one added to each count."""

    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray  # a row for each n-gram, and a last one for any other

    @classmethod
    def of(cls, counts: dict[tuple[str, int], int]) -> Model:
        """From counts of (language, number of an n-gram)."""
        languages, keys = sorted({lang for lang, _ in counts}), np.array(sorted({k for _, k in counts}), np.uint64)
        n = np.zeros((len(keys) + 1, len(languages)))
        for i, lang in enumerate(languages):
            own = [(k, c) for (x, k), c in counts.items() if x == lang]
            n[np.searchsorted(keys, np.array([k for k, _ in own], np.uint64)), i] = [c for _, c in own]
        return cls(languages, keys, np.log((n + 1) / (n.sum(axis=0) + len(keys))))

    def judge(self, text: str) -> tuple[str, float]:
        if len(text) < SHORT or not len(self.keys):
            return "en", 1.0
        c = np.sort(codes(text))  # in order they are looked up much faster
        at = np.minimum(np.searchsorted(self.keys, c), len(self.keys) - 1)
        seen = np.bincount(np.where(self.keys[at] == c, at, len(self.keys)), minlength=len(self.keys) + 1)
        used = np.flatnonzero(seen)
        score = seen[used] @ self.weights[used]
        best = int(score.argmax())
        if score[best] <= SURE:
            return self.languages[best], 1.0
        if score[best] <= LIKELY:
            return self.languages[best], 0.7
        return "en", min(0.4, max(0.1, -float(score[best]) / 100))


@cache
def builtin() -> Model:
    """The model of the package's own texts."""
    counts: Counter[tuple[str, int]] = Counter()
    for lang, text in TEXTS.items():
        counts.update((lang, k) for k in codes(" ".join(text.lower().split())).tolist())
    return Model.of(counts)


def gram_of(code: int) -> str:
    """The n-gram of a number, or `###` and the number of a block."""
    if code & int(BLOCK):
        return "#" * LONGEST + str(code ^ int(BLOCK))
    parts = [(code >> (int(PLACE) * i)) & ((1 << int(PLACE)) - 1) for i in range(LONGEST)]
    return "".join(chr(c - 1) for c in parts if c)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of texts (lang, text) that are tidy: the n-grams, and the blocks of characters as `###` and a number.
    Tasks add up what their own batches hold; only these sums are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                keys, n = np.unique(np.concatenate([codes(t) for t in own["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": list(map(gram_of, keys.tolist())), "n": n})

    rows = texts.where((F.length("text") > 0) & F.col("lang").isNotNull()).select("lang", "text")
    return rows.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, kept: int = KEPT) -> Model:
    """A model of labelled texts: of each language the per_language texts whose MD5 of the id is least (a bounded sample), and the
    `kept` n-grams that are most frequent over all of them. n-grams are counted by Spark; the driver gets the kept ones.
    Rows without a language are left out; without any language all texts are English."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), tidy(F.lit(""), F.col(text_col)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5("id"), "text"))
    counts = gram_counts(labelled.withColumn("nth", nth).where(F.col("nth") <= per_language))
    counts = counts.persist()
    try:
        frequent = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(kept)
        rows = counts.join(frequent, "gram").select("lang", "gram", "n").collect()
    finally:
        counts.unpersist()
    return Model.of({(r.lang, code_of(r.gram)): r.n for r in rows})


def detect(title: Column, body: Column, model: Model | None = None) -> Column:
    """(lang, confidence) of a title and the first 8192 characters of a body: the language under which its n-grams are likeliest.

    Below 30 characters English with confidence 1.0. The confidence comes from the log-probability: 1.0 up to SURE, 0.7
    up to LIKELY, and English above. The model is that of the package, or a fitted one.
    """
    sent = model or builtin()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([sent.judge(t or "") for t in texts], columns=["lang", "confidence"])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang string, confidence double")(tidy(title, body))
