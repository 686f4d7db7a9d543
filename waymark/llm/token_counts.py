"""Token counts of fields and sections from one encoding of the whole document, by offsets."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A fixed value: the pattern by which this public vocabulary splits texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "most", "last")
#: White space of the pattern's `\\s`, in runs that are too long for a matcher which backtracks.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % 4096)


def section_bounds(fields: list[bytes], splitter: bytes) -> tuple[bytes, list[tuple[int, int]], np.ndarray]:
    """The fields joined by the splitter, (field, section) of each section, and where each starts.

    Fields split at the splitter into sections; a section owns the splitter after it, so sections cover the document.
    """
    names, starts, at = [], [], 0
    for f, text in enumerate(fields):
        for s, part in enumerate(text.split(splitter)):
            names.append((f, s))
            starts.append(at)
            at += len(part) + len(splitter)
    return splitter.join(fields), names, np.array(starts, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a bound: an interval join of sorted spans.

    rule: a crossing token goes to the section of its first byte, of its last, or to the one with most of its bytes (the
    earlier of equals).
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    if rule == "first":
        return first, first != last
    if rule == "last":
        return last, first != last
    own = first.copy()
    for i in np.flatnonzero(first != last):
        edges = np.r_[starts[i], bounds[first[i] + 1 : last[i] + 1], ends[i]]
        own[i] = first[i] + int(np.argmax(np.diff(edges)))
    return own, first != last


def encode(coder, text: str) -> list[int]:
    """The tokens of a text; a run of white space of 4096 characters or more is one piece of its own, but for its last
    character where text follows, just as the pattern splits it (`\\s+(?!\\S)`), without a step back for each character."""
    ids, at = [], 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += coder.encode_ordinary(text[at : m.start()])
        ids += coder._encode_single_piece(text[m.start() : end])
        at = end
    return ids + coder.encode_ordinary(text[at:])


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def count_tokens(df: DataFrame, fields: list[str], id_col: str = "doc_id", splitter: str = "\n", rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Tokens of each document, attributed to the sections of its fields.

    The fields are joined by the splitter and encoded once, as a whole, so counts are those that training sees; each
    token's span of bytes, from the lengths of the tokens, then meets the spans of the sections. A token across a bound
    goes to one section, by the rule (first, most or last), so sections add up to the document. The driver reads the
    vocabulary and sends it to the workers (a few MB, whatever the data).

    Returns id, n_tokens, n_crossing and sections: field, section (numbers from 0), tokens. A null or empty field is one
    section without tokens of its own text. Texts of any length, runs of white space too, are encoded whole (another
    pattern than the default must cope with such runs itself). Each input row gives one row; an empty table gives none.
    """
    import tiktoken

    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    sent = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    docs = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    name, id_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    section = pa.struct([("field", pa.int32()), ("section", pa.int32()), ("tokens", pa.int64())])
    schema = pa.schema([("id", id_type), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("sections", pa.list_(section))])
    mark = splitter.encode()

    def run(batches):
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        length = np.zeros(max(sent.value.values(), default=0) + 1, np.int64)
        for token, rank in sent.value.items():
            length[rank] = len(token)
        for b in small(batches):
            total, crossing, offsets, parts = [], [], [0], [[], [], []]
            for own in zip(*(texts_of(b.column(i + 1)) for i in range(len(fields))), strict=True):
                text, names, bounds = section_bounds(list(own), mark)
                ids = np.array(encode(coder, text.decode("utf-8", "replace")) if pattern == PATTERN else coder.encode_ordinary(text.decode("utf-8", "replace")), np.int64)
                ends = np.cumsum(length[ids]) if len(ids) else np.zeros(0, np.int64)
                where, across = attribute(ends - length[ids] if len(ids) else ends, ends, bounds, rule)
                total.append(len(ids))
                crossing.append(int(across.sum()))
                parts[0] += [f for f, _ in names]
                parts[1] += [s for _, s in names]
                parts[2] += np.bincount(where, minlength=len(names)).tolist()
                offsets.append(len(parts[0]))
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(parts, section, strict=True)], fields=list(section))
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], schema=schema)

    return docs.mapInArrow(run, f"id {name}, n_tokens long, n_crossing long, sections array<struct<field:int,section:int,tokens:long>>")
