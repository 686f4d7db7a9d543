"""Language ID in two steps: the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small
from .training import labelled_sample, sigmoid, train

DIMENSIONS, PER_LABEL, COST, EPOCHS = 1 << 13, 600, 10.0, 20
#: Families of languages, by ISO 639-1 code. Other codes are families of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_NEAR_LETTER = re.compile(r"[^\W\d_]")
#: ASCII outside a-z becomes a space.
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is of a category of letters; other numbers, like fractions, are word characters but none."""
    return any(m[0].isalpha() for m in _NEAR_LETTER.finditer(text))


def family_of(lang: str) -> str:
    return _FAMILY.get(re.split("[-_]", lang.lower())[0], lang)


def features(text: str) -> np.ndarray:
    """Square roots of the frequencies of hashed byte trigrams of the lower-cased letters: a vector of length 1."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" ", np.uint8).astype(np.uint32)
    gram = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    gram = gram[gram != 0x202020]
    n = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMENSIONS)
    return np.sqrt(n / max(len(gram), 1)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights (the last for the constant) of a linear support vector machine, by dual coordinate descent; y is +1 or -1."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float64)
    each = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * cost
    w, a, norm, order = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), each[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


class Voter:
    """One-versus-one machines among some classes: most votes win, then the larger sum of margins."""

    def __init__(self, names: list[str], x: np.ndarray, labels: np.ndarray):
        self.names, self.pairs = names, list(combinations(range(len(names)), 2))
        self.w = np.zeros((x.shape[1] + 1, len(self.pairs)), np.float32)
        for k, (i, j) in enumerate(self.pairs):
            part = (labels == names[i]) | (labels == names[j])
            self.w[:, k] = svm(x[part], np.where(labels[part] == names[i], 1.0, -1.0))

    def pick(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.names[0], 1.0
        margin = x @ self.w[:-1] + self.w[-1]
        votes, least, total = np.zeros(len(self.names)), np.full(len(self.names), np.inf), np.zeros(len(self.names))
        for m, (i, j) in zip(margin.tolist(), self.pairs, strict=True):
            votes[i if m > 0 else j] += 1
            for k, own in ((i, m), (j, -m)):
                total[k] += own
                least[k] = min(least[k], own)
        best = max(range(len(self.names)), key=lambda k: (votes[k], total[k]))
        return self.names[best], float(sigmoid(4 * least[best]))


class Model:
    def __init__(self, sample: list[tuple[str, str]], counts: dict[str, int] | None = None):
        sample = [(t, label) for t, label in sample if has_letter(t)]
        labels = np.array([label for _, label in sample], object)
        x = np.array([features(t) for t, _ in sample], np.float32).reshape(-1, DIMENSIONS)
        kinds = np.array([family_of(label) for label in labels], object)
        self.families = Voter(sorted(set(kinds)), x, kinds) if sample else None
        self.within = {f: Voter(sorted(set(labels[kinds == f])), x[kinds == f], labels[kinds == f]) for f in set(kinds)}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.families is None or not has_letter(text):
            return "und", 0.0
        x = features(text)
        family, sure = self.families.pick(x)
        lang, surer = self.within[family].pick(x)
        return lang, sure * surer


def identify(df: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL) -> DataFrame:
    """The language of each whole text: id, lang_pred, score (0 to 1).

    Learns from about per_label usable rows of each language (a bounded sample, drawn by a hash of the id). Prediction
    takes the text alone. `und`, with score 0, for a null text, a text without letters, and where nothing could be
    learned. Repeated rows all get a row; an empty table gives none. Texts of any length are read whole; extra columns
    are left out, whatever their names. usable: a condition on the column `id`.
    """
    model = train(Model, *labelled_sample(df, None, id_col, text_col, lang_col, F.lit(True) if usable is None else usable, per_label))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name, id_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    schema = pa.schema([("id", id_type), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in small(batches):
            found = [model.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], schema=schema)

    return docs.mapInArrow(run, f"id {name}, lang_pred string, score double")
