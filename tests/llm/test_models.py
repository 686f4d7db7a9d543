"""Trained operators: accuracy on held-out rows, awkward cases, and the marginals of the field by brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import queries
from waymark.llm.common import held_out
from waymark.llm.language_id import family_of, identify
from waymark.llm.quality import classify_quality
from waymark.llm.toxicity import Model, forward_backward, tag_toxicity
from waymark.llm.training import labelled_sample, logistic

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, id string, score string, label int"
AWKWARD = [(1, None, "en"), (2, "", "de"), (3, "12 345 !!", None), (4, "wort " * 40000, "de"), (None, "the null id", "en"), (5, "the same", "en"), (5, "the same", "en")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "a", "b", 0) for i, t, x in rows], SCHEMA)


def talk(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def test_language_of_held_out_rows(spark):
    found = queries.op3_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = found.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.right > 0.95 and 0 <= r.lo <= r.hi <= 1


def test_language_of_awkward_rows(spark):
    rnd = random.Random(0)
    rows = AWKWARD + [(10 + i, talk(rnd, "der die und nicht wort zeit".split(), 20), "de") for i in range(20)] + [(50 + i, talk(rnd, "the of and not word time".split(), 20), "en") for i in range(20)] + [(90, "the of and", None)]
    got = {(r.id, r.lang_pred) for r in identify(docs(spark, rows)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (90, "en")} <= got
    assert identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in identify(docs(spark, rows), F.lit(False)).collect()} == {"und"}
    one = identify(docs(spark, [(1, "abc", "xx"), (2, "def", None), (3, None, None)])).collect()
    assert {(r.id, r.lang_pred) for r in one} == {(1, "xx"), (2, "xx"), (3, "und")}


def test_families():
    assert family_of("pt-BR") == family_of("fr") != family_of("de") and family_of("tlh") == "tlh"


def scored(spark, query, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return query(spark, DATA).join(labels, "doc_id").where("held_out").toPandas()


def test_toxicity_of_held_out_rows(spark):
    p = scored(spark, queries.op6_toxicity, "toxic")
    hit = ((p.predicted == 1) & (p.y == 1)).sum()
    assert hit / (p.y == 1).sum() >= 0.6 and hit / max((p.predicted == 1).sum(), 1) >= 0.7
    assert p.score.between(0, 1).all()


def test_quality_of_held_out_rows(spark):
    p = scored(spark, queries.op10_quality, "quality")
    assert (p.predicted == p.y).mean() > 0.9 and p.score.between(0, 1).all()


def toxic_rows():
    rnd = random.Random(1)
    clean = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        w = [rnd.choice(clean) for _ in range(40)]
        y = i % 5 == 0
        if y:
            for _ in range(3):
                w[rnd.randrange(40)] = rnd.choice(["vileone", "Vileness", "nastier"])
        rows.append((1000 + i, " ".join(w), "en"))
        labels.append((1000 + i, int(y)))
    return rows, labels


def test_toxic_spans(spark):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (1000, 1)], "doc_id long, toxic int")
    texts = [(1, "word1 É VILENESS vileone, word2", "en"), (2, None, "en"), (3, "", "en"), (4, "word3 " * 30000 + "nastier", "en"), (None, "nastier nastier", "en")]
    got = {r.id: r for r in tag_toxicity(docs(spark, rows + texts), lab).where("id < 1000 or id is null").collect()}
    assert [texts[0][1][s.start : s.end] for s in got[1].spans] == ["VILENESS vileone"] and got[1].predicted == 1
    assert got[2].spans == got[3].spans == [] and got[2].predicted == 0 and got[2].score == got[3].score
    assert got[4].spans[-1].end == len(texts[3][1]) and got[None].predicted == 1
    assert tag_toxicity(docs(spark, []), lab).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, len(r.spans)) for r in tag_toxicity(docs(spark, texts), empty).collect()} == {(0.0, 0)}


def test_marginals_of_slow_chains():
    """A start that holds on for hundreds of words, against the plain recursions, wherever the document lies."""
    rnd = np.random.default_rng(1)
    trans, start, n = np.array([[1.0, 0.001], [0.001, 1.0]]), 0.3, 400
    emit = np.exp(rnd.normal(0, 0.05, n))
    ahead, back = np.empty(n), np.ones(n)
    for t in range(n):
        r = ahead[t - 1]
        ahead[t] = emit[t] * ((trans[0, 1] + trans[1, 1] * r) / (trans[0, 0] + trans[1, 0] * r) if t else start)
    for t in range(n - 2, -1, -1):
        h = emit[t + 1] * back[t + 1]
        back[t] = (trans[1, 0] + trans[1, 1] * h) / (trans[0, 0] + trans[0, 1] * h)
    for before, after in ((0, 0), (37, 0), (64, 1), (5, 150)):
        size = before + n + after
        first = np.isin(np.arange(size), [0, before, before + n])
        e = np.r_[np.exp(rnd.normal(0, 2, before)), emit, np.exp(rnd.normal(0, 2, after))]
        got = forward_backward(e, first, trans, start)
        assert got[0][before : before + n] == pytest.approx(ahead, rel=1e-9) and got[1][before : before + n] == pytest.approx(back, rel=1e-9)


def test_marginals_in_any_order():
    """A trained model gives a text the same marginals in another order of the rows."""
    rnd = np.random.default_rng(2)
    text = lambda n, bad: " ".join("vileword" if bad and rnd.random() < 0.2 else f"word{rnd.integers(300)}" for _ in range(n))
    sample = [(text(int(rnd.integers(5, 200)), k % 2), k % 2) for k in range(120)]
    model = Model(sample, {0: 60, 1: 60})
    docs = [t.split() for t, _ in sample]
    there, back = model.marginals(docs, {}), model.marginals(docs[::-1], {})[::-1]
    for x, y, ws in zip(there, back, docs, strict=True):
        assert x == pytest.approx(y, abs=1e-9) and x == pytest.approx(model.marginals([ws], {})[0], abs=1e-9)


def test_marginals():
    """The lanes of the forward-backward pass against all paths."""
    rnd = np.random.default_rng(0)
    trans, start = np.array([[1.3, 0.1], [0.6, 0.9]]), 0.2
    for sizes in ([5, 1, 7], [1], [9]):
        emit = np.exp(rnd.normal(0, 2, sum(sizes)))
        first = np.zeros(len(emit), bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        ahead, back = forward_backward(emit, first, trans, start)
        p, at = ahead * back / (1 + ahead * back), 0
        for n in sizes:
            total, mass = 0.0, np.zeros(n)
            for path in itertools.product((0, 1), repeat=n):
                x = start if path[0] else 1.0
                for k, y in enumerate(path):
                    x *= emit[at + k] if y else 1.0
                    x *= trans[path[k - 1], y] if k else 1.0
                total += x
                mass += x * np.array(path)
            assert p[at : at + n] == pytest.approx(mass / total)
            at += n
    # one chain in many lanes is the same as the plain recursion
    emit = np.exp(rnd.normal(-1, 2, 1000))
    first = np.zeros(1000, bool)
    first[0] = True
    ahead, _ = forward_backward(emit, first, trans, start)
    r = emit[0] * start
    for t in range(1, 1000):
        r = emit[t] * (trans[0, 1] + trans[1, 1] * r) / (trans[0, 0] + trans[1, 0] * r)
        assert ahead[t] == pytest.approx(r, rel=1e-6)


def test_sample_of_repeated_ids(spark):
    """10,000 rows of one id: the sample keeps its bound, and repeated rows count once."""
    rows = [(7, f"text number {i}", "en") for i in range(9000)] + [(7, "the same text", "en")] * 1000 + [(8, "ein text", "de"), (9, "x" * 600, "en"), (None, "no id", "en"), (10, None, "en")]
    df = docs(spark, rows).repartition(5)
    sample, counts = labelled_sample(df, None, "doc_id", "text", "lang", F.lit(True), 50, most_bytes=500)
    got = sample.collect()
    assert counts == {"en": 10002, "de": 1} and 20 < len(got) <= 200 and len(set(got)) == len(got)
    assert sorted(got) == sorted(labelled_sample(df.repartition(3), None, "doc_id", "text", "lang", F.lit(True), 50, most_bytes=500)[0].collect())
    assert ("de" in {r.label for r in got}) and all(r.id in (7, 8) for r in got)
    lab = spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id long, y int")
    sample, counts = labelled_sample(df, lab, "doc_id", "text", "y", F.lit(True), 50)
    got = sample.collect()
    assert counts == {0: 1, 1: 1} and len(got) <= 200 and {r.label for r in got if r.id == 7} == {1} and len(set(got)) == len(got)
    wide = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, y int")
    assert labelled_sample(df, wide, "doc_id", "text", "y", F.lit(False), 50)[1] == {}


def test_one_label(spark):
    assert Model([("a b", 1)], {1: 4}).weights is None
    lab = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    assert {r.score for r in classify_quality(docs(spark, AWKWARD), lab).collect()} == {1.0}
    assert {r.score for r in classify_quality(docs(spark, AWKWARD), lab.limit(0)).collect()} == {0.5}


def test_quality_of_awkward_rows(spark):
    rnd = random.Random(3)
    good = [(100 + i, talk(rnd, [f"plain{j}" for j in range(60)], 120), "en") for i in range(60)]
    bad = [(300 + i, talk(rnd, [f"$$${j}%%%" for j in range(60)], 120), "en") for i in range(60)]
    lab = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    got = {r.id: r.predicted for r in classify_quality(docs(spark, good + bad + AWKWARD), lab).collect()}
    assert np.mean([got[i] == 1 for i, _, _ in good] + [got[i] == 0 for i, _, _ in bad]) > 0.95
    assert got[1] == got[2] and len(got) == 120 + len({i for i, _, _ in AWKWARD})
    assert classify_quality(docs(spark, []), lab).count() == 0


def test_logistic_keeps_the_share():
    rnd = np.random.default_rng(1)
    y = (rnd.random(400) < 0.5).astype(int)
    x = rnd.normal(0, 1e-6, (400, 1))
    w = logistic(x, y, 1e-6, 0.1)
    assert 1 / (1 + np.exp(-w[-1])) == pytest.approx(0.1, abs=0.01)


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.createDataFrame([(None,)], "id long").select(held_out(F.col("id"), 4, 2).alias("h")).first().h


def test_letters():
    from waymark.llm.language_id import has_letter

    assert all(map(has_letter, ["a", "1é", "日", "ª", "ʰ", "ǅ"])) and not any(map(has_letter, ["", "12 _-", "²½", "Ⅷ³ 7", "é".encode().decode("latin-1")[1:] + "\u0301"]))
