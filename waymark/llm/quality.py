"""Quality classifier by compression: which of two zstandard dictionaries makes a text smaller."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small, texts_of
from .training import labelled_sample, logistic, share_of_ones, sigmoid, train, unlike

PER_LABEL, DICTIONARY, LEVEL = 1500, 112_640, 3
#: A text is compressed in pieces of so many bytes, so that the dictionaries matter throughout a long text.
PIECE = 1024


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the pieces of the texts; of the pieces as they are where there are too few to train on."""
    parts = [p for t in texts for p in pieces(t) if len(p) >= 8]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(sum(map(len, parts)) // 4, 1024)), parts)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(parts)[-DICTIONARY:] or b"\x00" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Compressors:
    def __init__(self, good: tuple[bytes, int], bad: tuple[bytes, int]):
        self.of = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_dict_id=False) for d, kind in (good, bad)]

    def measure(self, text: bytes) -> float:
        """(bad - good) / (bad + good) of the compressed sizes, above 0 if the good dictionary fits better."""
        good, bad = (sum(len(c.compress(p)) for p in pieces(text)) for c in self.of)
        return (bad - good) / (bad + good) if good else 0.0


#: Brings differences near 1 for the calibration.
SCALE = 100.0


class Model:
    """Half of the sample, without near copies, makes the dictionaries; the other half calibrates the difference."""

    def __init__(self, sample: list[tuple[str, int]], counts: dict[int, int]):
        texts = [t.encode("utf-8", "replace") for t, _ in sample]
        y = np.array([int(bool(label)) for _, label in sample])
        self.weights, self.prior, self.dictionaries = None, share_of_ones(counts) if counts else 0.5, None
        if len(set(y)) < 2:
            return
        alone = unlike(texts)
        first = np.array([xxhash.xxh3_64_intdigest(t) % 2 == 0 for t in texts])
        own = [[t for t, k in zip(texts, (y == label) & first & alone, strict=True) if k] or [t for t, k in zip(texts, y == label, strict=True) if k] for label in (1, 0)]
        # as many bytes for either, so that neither dictionary fits better for its size
        most = min(sum(map(len, o)) for o in own)
        kinds = []
        for o in own:
            ends = np.cumsum([len(t) for t in o])
            d = dictionary(o[: max(1, int((ends <= most).sum()))])
            kinds.append((d.as_bytes(), zstandard.DICT_TYPE_FULLDICT if d.as_bytes()[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT))
        self.dictionaries = kinds
        c = Compressors(*kinds)
        rest = ~first & alone if len(set(y[~first & alone])) == 2 else np.ones(len(y), bool)
        x = np.array([c.measure(t) for t, k in zip(texts, rest, strict=True) if k])
        self.weights = logistic(x.reshape(-1, 1) * SCALE, y[rest], 1e-2, self.prior)


def classify_quality(df: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, per_label: int = PER_LABEL) -> DataFrame:
    """How likely label 1 is for each whole text: id, difference, score (0 to 1), predicted.

    Two zstandard dictionaries are built from about per_label usable texts of each label (a bounded sample, drawn by a
    hash of the id). The difference of the two compressed sizes over their sum goes through a logistic fit on texts that
    the dictionaries haven't seen, and is the score: a higher difference is never a lower score, unless the sample says
    the contrary. A null or empty text has the difference 0. With labels of one kind only, or none, the score is the
    share of label 1, or 0.5. Texts of any length are compressed whole, in pieces. Repeated rows all get a row; an empty
    table gives none; extra columns are left out, whatever their names. usable: a condition on the column `id`.
    """
    model = train(Model, *labelled_sample(df, labels, id_col, text_col, label_col, F.lit(True) if usable is None else usable, per_label))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name, id_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    schema = pa.schema([("id", id_type), ("difference", pa.float64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        m = model.value
        c = Compressors(*m.dictionaries) if m.dictionaries else None
        for b in small(batches):
            x = np.array([c.measure(t) if c else 0.0 for t in texts_of(b.column(1))], np.float64)
            score = sigmoid(x * SCALE * m.weights[0] + m.weights[1]) if c else np.full(len(x), m.prior)
            yield pa.record_batch([b.column(0), pa.array(x), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, f"id {name}, difference double, score double, predicted int")
