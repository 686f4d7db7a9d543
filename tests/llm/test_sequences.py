"""Prefix tries, periodic runs and media columns: brute force on small tables with every awkward case."""

import hashlib
import random
import re
import wave
import zlib
from collections import defaultdict
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import media, periodic
from waymark.llm import prefix_trie as trie
from waymark.llm import queries
from waymark.llm.media import audio_features, padded, read_tensors, read_wav, wav
from waymark.llm.periodic import periodic_runs, runs_of, stretches
from waymark.llm.prefix_trie import Louds, label_turns, prefix_trie, rebuild

TURNS = "conv_id long, turn long, role string, text string, pos string, id int, label string, words string, shard long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def turns(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "p", 1, "l", "w", 2) for r in rows], TURNS).repartition(parts)


def brute_trie(sequences):
    """Nodes of a trie of {conv_id: [(role, text), ...]}."""
    members, below = defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                below[tuple(s[: d - 1])].add(tuple(s[:d]))
    saved = {p: (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0 for p, m in members.items()}
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = below[p]
        leaves, total = sum(out[k][5] for k in kids) or 1, saved[p] + sum(out[k][6] for k in kids)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(sequences[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves, total, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def originals(rows):
    """The turns of each conversation, in order; ties go by the label that the operator uses."""
    label = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
    held = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            held[c].append((n is not None, n or 0, label(r or "", t or ""), r or "", t or ""))
    return {c: [(x[3], x[4]) for x in sorted(s)] for c, s in held.items()}


def brute_rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def conversations():
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a b", "c", "", None, "d e  f"])) for c in range(70) for t in range(r.randrange(1, 7))]
    rows += [(c, t, "user", "the same" if t < 4 else f"then {c}") for c in range(100, 160) for t in range(5)]  # a hot prefix
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(3)]  # copies
    rows += [(300, t, "user", f"long {t % 3}") for t in range(150)] + [(301, 0, "user", "w " * 40_000)]
    return rows + [(400, None, "user", "null turn"), (400, 1, "bot", "x"), (400, 1, "bot", "y"), (400, 1, "bot", "y"), (None, 0, "user", "nobody's"), (401, 5, "é ", " é")]


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize(("shard_turns", "upper_nodes", "block"), [(100_000, 1000, 4096), (60, 1000, 7), (10, 5, 4096)])
def test_prefix_trie(spark, monkeypatch, shard_turns, upper_nodes, block):
    monkeypatch.setattr(trie, "ID_BLOCK", block)
    rows = conversations()
    if upper_nodes < 10:  # a round for each level, so few levels
        rows = [x for x in rows if x[0] != 300]
    labelled = label_turns(turns(spark, rows))
    names = labelled.select("conv_id").distinct()
    got = prefix_trie(rebuild(labelled, names), names, shard_turns, upper_nodes)
    assert sorted([tuple(x[c] for c in NODE) for x in got.collect()], key=str) == brute_trie(brute_rebuilt(originals(rows)))


def test_trie_of_own_turns_and_of_nothing(spark):
    rows = conversations()[:200]
    labelled = label_turns(turns(spark, rows))
    got = prefix_trie(labelled, labelled.select("conv_id").distinct(), 20)
    assert sorted([tuple(x[c] for c in NODE) for x in got.collect()], key=str) == brute_trie(originals(rows))
    none = label_turns(turns(spark, [(None, 1, "user", "x")]))
    assert prefix_trie(rebuild(none, none.select("conv_id").distinct()), none.select("conv_id").distinct()).count() == 0


def test_louds():
    ids, parents = np.array([b"r", b"a", b"b", b"c", b"d", b"e"], "V17"), np.array([b"-", b"r", b"r", b"b", b"a", b"a"], "V17")
    t, order = Louds.build(ids[::-1].copy(), parents[::-1].copy())
    names = [bytes(x).strip(b"\0").decode() for x in ids[::-1][order]]
    assert names[0] == "r" and set(names[1:3]) == {"a", "b"} and t.levels.tolist() == [0, 1, 3, 6]
    parent = [names[p] if p >= 0 else "-" for p in t.parents()]
    assert dict(zip(names, parent, strict=True)) == {"r": "-", "a": "r", "b": "r", "c": "b", "d": "a", "e": "a"}
    assert dict(zip(names, t.children().tolist(), strict=True)) == {"r": 2, "a": 2, "b": 1, "c": 0, "d": 0, "e": 0}
    assert dict(zip(names, t.up(np.ones(6, int)).tolist(), strict=True)) == {"r": 6, "a": 3, "b": 2, "c": 1, "d": 1, "e": 1}
    assert len(t.bits) == 2 * 6 + 1


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of():
    r = random.Random(5)
    for _ in range(600):
        docs = [[r.randrange(r.choice([1, 2, 3, 8])) for _ in range(r.randrange(70))] for _ in range(3)]
        for d in docs:
            if d and r.random() < 0.5:
                a, p = r.randrange(len(d)), r.randrange(1, 9)
                d[:] = [x if i < a else d[a + (i - a) % p] for i, x in enumerate(d)]
        assert [runs_of(np.array(d, np.int64)) for d in docs] == [brute_runs(d) for d in docs]
        # every run lies within a stretch of its own document
        words, own = np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(3), [len(d) for d in docs])
        found = stretches(words, own)
        for k, d in enumerate(docs):
            first = sum(map(len, docs[:k]))
            for s, size, _ in brute_runs(d):
                assert any(a <= first + s and first + s + size <= z <= first + len(d) for a, z in found)


def looped(i, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    return w


def digest(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_periodic_runs_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "MANY", 3)
    r = random.Random(2)
    texts = [None, "", " \n", "a", "a a a a a a", "a  a\ta\na a", "a b a b a b a b", "x " * 3000, "é é é é é é  Ü", " ".join(r.choice("ab") for _ in range(200)), "one two three " * 50 + "end"]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(120))) for _ in range(120)]
    rows = [(i, t, "s", 1, "c") for i, t in enumerate(texts)] + [(4, texts[4], "s", 1, "c"), (None, texts[4], "s", 1, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, id int, collapsed string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        w = looped(i, t) if i is not None else WORD.findall(t)
        runs = brute_runs(w)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=str)
    assert sum(x[1] > 0 for x in want) >= 15


def test_periodic_runs_of_long_texts_and_nothing(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    [r] = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, [tuple(x) for x in r.runs], len(r.collapsed.split())) == (60_000, [(0, 60_000, 5000)], 5000)
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_query(spark, tmp_path):
    texts = [None, "", "a", "b" * 192, "c" * 193, "é" * 96, "Same text.\nAgain", "Same text.\nAgain", "loud ~~~~ " * 30_000]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, "nobody", "x", 1, "y"), (3, texts[3], "x", 1, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, media string, row int, payload string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_media_columns(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode() if r.doc_id is not None else b"nobody"
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert by_text.setdefault(raw, r.feature) == r.feature and r.feature


def test_sound_files(spark):
    payloads = [b"", b"\x00", b"odd", bytes(range(256)) * 3]
    stored = [r.media for r in spark.createDataFrame([(bytearray(p),) for p in payloads], "p binary").select(wav(F.col("p")).alias("media")).collect()]
    for p, m in zip(payloads, stored, strict=True):
        assert read_wav(bytes(m)) == (8000, p)
        with wave.open(BytesIO(bytes(m))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(9999)) == (1, 1, 8000, p)
    with pytest.raises(ValueError, match="not a sound file"):
        read_wav(b"text")
    assert [len(r[0]) for r in spark.createDataFrame([("",), ("x" * 192,), ("x" * 193,)], "t string").select(padded(F.col("t"))).collect()] == [192, 192, 384]


@pytest.mark.parametrize(("up", "down"), [(3, 4), (2, 1), (1, 3), (5, 7)])
def test_resample(up, down):
    for n in (0, 1, 5, 192, 5000):
        x = np.random.default_rng(n).normal(size=n).astype(np.float32)
        h, z = media.low_pass(up, down), np.zeros(n * up)
        z[::up] = x
        want = np.convolve(z, h)[len(h) // 2 :][: n * up : down] if n else z
        got = media.resample(x, up, down)
        assert len(got) == -(-n * up // down) and np.allclose(got, want, atol=1e-4)
    tone = np.sin(2 * np.pi * 200 * np.arange(8000) / 8000)
    own = media.resample(tone, up, down)
    assert np.allclose(own[200:-200], np.sin(2 * np.pi * 200 * np.arange(len(own)) * down / up / 8000)[200:-200], atol=0.02)


def test_log_mel_and_segments(monkeypatch):
    tone = np.sin(2 * np.pi * 1000 * np.arange(6000) / 6000).astype(np.float32)
    mels, energy = media.log_mel(tone, 6000)
    assert len(mels) == len(energy) == 1 + -(-(6000 - 256) // 128)
    bands = media.mel_bands(6000)
    assert bands[round(1000 / 3000 * 128)].argmax() == mels.mean(axis=0).argmax()
    frame = tone[256 : 256 + 256]  # the third frame
    want = 10 * np.log10(np.abs(np.fft.rfft(frame * np.hanning(256))) ** 2 @ bands + 1e-10)
    assert np.allclose(mels[2], want, atol=0.05)
    monkeypatch.setattr(media, "STEP", 7)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(media.log_mel(tone, 6000), (mels, energy), strict=True))
    assert media.segments(np.array([0, 0, 0, 2, 0.5, 2, 0, 0, 5.0, 0.3])) == [(3, 6), (8, 9)]
    assert media.segments(np.zeros(5)) == media.segments(np.zeros(0)) == []


def test_tensors(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, None)], "doc_id long, text string")
    rows = {r.id: r for r in audio_features(docs.select("doc_id", F.when(F.col("doc_id") == 1, wav(padded(F.col("text")))).alias("media"))).collect()}
    cube, spans = read_tensors(bytes(rows[1].tensors))
    assert cube.shape == (-(-rows[1].n_frames // media.WINDOW), media.WINDOW, media.MELS) and cube.dtype == np.float32
    assert sum(n for *_, n in spans) == rows[1].n_frames and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert rows[2].payload is rows[2].tensors is rows[2].feature is None
    assert audio_features(docs.where("false").select("doc_id", F.lit(b"").alias("media"))).count() == 0
