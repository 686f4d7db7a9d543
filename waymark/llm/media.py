"""Media columns: lossless 8-bit sound, log-mel features and segments, kept as fixed-shape Arrow tensors."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small

#: A payload is filled with spaces up to a multiple of this many bytes.
BLOCK = 192
#: Samples a second as stored, and the fraction (up, down) of it at which features are made.
RATE, UP, DOWN = 8000, 3, 4
#: Samples and step of a frame, mel bands, and frames of a tensor.
FRAME, HOP, MELS, WINDOW = 256, 128, 32, 32
#: A segment starts this many dB over the median energy of the frames, and ends below the second.
RISE, FALL = 1.0, 0.25
#: Frames, or steps of the filter, that are worked on at once.
STEP = 8192
FLOOR = 1e-10


def padded(text: Column) -> Column:
    """The UTF-8 bytes of a text (null as empty), with spaces up to a positive multiple of BLOCK."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return F.rpad(raw, F.greatest(F.lit(BLOCK), F.ceil(F.octet_length(raw) / BLOCK) * BLOCK).cast("int"), F.lit(b" "))


def _little(number: Column | int) -> Column:
    """Four bytes, the lowest first."""
    big = F.unhex(F.lpad(F.hex(F.lit(number) if isinstance(number, int) else number), 8, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in (4, 3, 2, 1)])


def wav(payload: Column, rate: int = RATE) -> Column:
    """A sound file of one channel of unsigned 8-bit samples: each byte of the payload is a sample."""
    size, odd = F.octet_length(payload), F.octet_length(payload) % 2
    head = F.lit(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data")
    return F.concat(F.lit(b"RIFF"), _little(size + odd + 36), head, _little(size), payload, F.when(odd == 1, F.lit(b"\0")).otherwise(F.lit(b"")))


def read_wav(media: bytes) -> tuple[int, bytes]:
    """The rate and the sample bytes of a sound file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a sound file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is read")
        if name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a sound file without data")


@cache
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold."""
    most = max(up, down)
    t = np.arange(-half * most, half * most + 1)
    return np.sinc(t / most) * np.hanning(len(t) + 2)[1:-1] / most * up


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down of its rate. The filter falls apart into `up` phases, each with the taps that meet a real sample, so
    that nothing is worked out for the zeros between samples or for outputs that are left out."""
    h = low_pass(up, down)
    centre, taps = len(h) // 2, -(-len(h) // up)
    offsets = [(r * down + centre) // up for r in range(up)]
    low, high = min(offsets) - taps + 1, max(offsets)
    phases = np.zeros((high - low + 1, up), np.float32)
    for r in range(up):
        own = h[(r * down + centre) % up :: up]
        for i, tap in enumerate(own):
            phases[offsets[r] - i - low, r] = tap
    count = -(-len(x) * up // down)
    steps = -(-count // up)
    if not count:
        return np.zeros(0, np.float32)
    filled = np.concatenate([np.zeros(max(0, -low), np.float32), x.astype(np.float32), np.zeros(max(0, steps * down + high - len(x)) + 1, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(filled[max(0, low) :], high - low + 1)[::down]
    return np.concatenate([views[i : min(i + STEP, steps)] @ phases for i in range(0, steps, STEP)]).reshape(-1)[:count]


@cache
def mel_bands(rate: float, frame: int = FRAME, bands: int = MELS) -> np.ndarray:
    """Triangles, equally wide on the mel scale, over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, frame // 2 + 1)
    up, down = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The log-mel spectrum of overlapping frames (frames, MELS) in dB, and the energy of each frame in dB. The last frame is
    filled with zeros; a sound of less than a frame is one frame."""
    count = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((count - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bands, shape = mel_bands(rate), np.hanning(FRAME).astype(np.float32)
    mels, energy = [], []
    for i in range(0, count, STEP):
        own = frames[i : i + STEP]
        spectrum = np.fft.rfft(own * shape)
        mels.append(10 * np.log10((spectrum.real**2 + spectrum.imag**2) @ bands + FLOOR))
        energy.append(10 * np.log10((own * own).mean(axis=1) + FLOOR))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energy)


def segments(energy: np.ndarray, rise: float = RISE, fall: float = FALL) -> list[tuple[int, int]]:
    """(first, end) frames of loud stretches: one starts where the energy reaches the median and `rise`, and lasts until it
    is below the median and `fall`, so that small dips don't break it."""
    if not len(energy):
        return []
    middle = float(np.median(energy))
    mark = np.where(energy >= middle + rise, 1, np.where(energy < middle + fall, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.r_[False, (last >= 0) & (mark[last] == 1), False]
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def pack_tensors(mels: np.ndarray, ms_a_frame: float) -> bytes:
    """An Arrow stream of one batch: a row for each window of WINDOW frames, with its time span in ms, its frames and a
    fixed-shape tensor (WINDOW, MELS); the last one is filled with zeros."""
    count = -(-len(mels) // WINDOW)
    cube = np.zeros((count * WINDOW, MELS), np.float32)
    cube[: len(mels)] = mels
    first = np.arange(count) * WINDOW
    end = np.minimum(first + WINDOW, len(mels))
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(cube.reshape(count, WINDOW, MELS))
    batch = pa.record_batch([pa.array(first * ms_a_frame), pa.array(end * ms_a_frame), pa.array((end - first).astype(np.int32)), tensor], names=["start_ms", "end_ms", "frames", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(blob: bytes) -> tuple[np.ndarray, list[tuple[float, float, int]]]:
    """The tensors (windows, WINDOW, MELS) and the (start_ms, end_ms, frames) of each window."""
    t = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return t.column("tensor").combine_chunks().to_numpy_ndarray(), list(zip(*(t.column(c).to_pylist() for c in ("start_ms", "end_ms", "frames")), strict=True))


def features(media: bytes) -> tuple[bytes, int, list[tuple[float, float]], bytes, str]:
    """What a sound file holds: its samples, the frames, loud spans in ms, packed tensors and a summary."""
    rate, payload = read_wav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x - x.mean(dtype=np.float64).astype(np.float32) if len(x) else x)
    own = rate * UP / DOWN
    mels, energy = log_mel(y, own)
    ms = 1000 * HOP / own
    spans = [(a * ms, b * ms) for a, b in segments(energy)]
    summary = {"rate": int(own), "frames": len(mels), "segments": len(spans), "active_ms": round(sum(b - a for a, b in spans)), "energy_db": round(float(energy.mean())), "mel_db": np.rint(mels.mean(axis=0, dtype=np.float64)).astype(int).tolist()}
    return payload, len(mels), spans, pack_tensors(mels, ms), json.dumps(summary, separators=(",", ":"))


def audio_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Features of a column of sound files (one channel of 8-bit samples), read from the stored bytes.

    The samples, less their mean, are resampled by a polyphase filter and cut into overlapping frames; each gives MELS
    bands in dB. Loud stretches come from the frames' energy with hysteresis. Long sounds are worked on in blocks, so that a
    row takes some ten times its own bytes.

    Returns id, payload (the sample bytes), n_frames, segments (start_ms, end_ms), tensors (an Arrow stream of fixed-shape
    tensors with their time spans, see read_tensors) and feature, a summary as JSON. Equal sounds give equal values. A null
    sound gives nulls. Each input row gives one row, repeated rows too; extra columns are left out, whatever their names; an empty table gives
    none. Work is by row, so hot keys play no part.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"))
    name, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    span = pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())])
    schema = pa.schema([("id", id_type), ("payload", pa.binary()), ("n_frames", pa.int64()), ("segments", pa.list_(span)), ("tensors", pa.binary()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [(None,) * 5 if m is None else features(m) for m in b.column(1).to_pylist()]
            cols = [list(c) for c in zip(*found, strict=True)] if found else [[]] * 5
            cols[2] = [None if s is None else [{"start_ms": a, "end_ms": z} for a, z in s] for s in cols[2]]
            yield pa.record_batch([b.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return rows.mapInArrow(run, f"id {name}, payload binary, n_frames long, segments array<struct<start_ms:double,end_ms:double>>, tensors binary, feature string")
