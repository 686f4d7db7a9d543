"""The language detector: the built-in model, a fitted one, and its counts against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import language, ngrams

PAIRS = [
    ("en", "Welcome to our forum", "This is a great community for open discussion and sharing knowledge."),
    ("de", "Willkommen im Forum", "Dies ist eine großartige Community für offene Diskussionen."),
    ("ja", "フォーラムへようこそ", "これはオープンな議論と知識共有のための素晴らしいコミュニティです。"),
    ("zh", "欢迎来到论坛", "这是一个伟大的社区，可以进行公开讨论和知识共享。"),
    ("ru", "Добро пожаловать на форум", "Это отличное сообщество для открытых обсуждений и обмена знаниями."),
    ("en", "", "foo bar baz"),
    ("en", None, None),
    ("fr", "Accueil", "Bienvenue chez nous, vous pouvez lire les annonces et écrire à l'équipe."),
    ("es", "", "Los vecinos del barrio quieren una plaza nueva para los niños."),
    ("ru", "", "слово " * 5000),
]


def test_builtin(spark):
    rows = spark.createDataFrame([(i, t, b) for i, (_, t, b) in enumerate(PAIRS)], "i int, t string, b string")
    got = {r.i: r.f for r in rows.select("i", language.detect(F.col("t"), F.col("b")).alias("f")).collect()}
    assert [got[i].lang for i in range(len(PAIRS))] == [p[0] for p in PAIRS] and all(0 <= f.confidence <= 1 for f in got.values())
    assert rows.where("false").select(language.detect(F.col("t"), F.col("b"))).count() == 0


def test_confidence():
    m = ngrams.Model(["de", "fr"], np.array([ngrams.code_of("a")], np.uint64), np.array([[-0.5, -0.4], [-0.01, -0.01]]))
    text = lambda n: "a" * n + "b" * (40 - n)
    # 160 - 1 - 2 n-grams; n of them are an `a`
    assert m.judge("short") == ("en", 1.0) and m.judge(text(40))[0] == "fr" and m.judge(text(40))[1] == 1.0 * (0.4 * 40 + 1.17 > 50) or m.judge(text(40)) == ("en", pytest.approx(0.1717, abs=0.01))
    sure = ngrams.Model(["de"], m.keys, np.array([[-2.0], [0.0]]))
    assert sure.judge(text(30)) == ("de", 1.0) and sure.judge(text(12)) == ("de", 0.7) and sure.judge(text(6)) == ("en", pytest.approx(0.12))


def test_counts_and_codes(spark):
    texts = [("x", "abé日 a"), ("x", "ab"), ("y", "a"), ("y", "")]
    got = {(r.lang, r.gram): r.n for r in ngrams.gram_counts(spark.createDataFrame(texts, "lang string, text string")).collect()}
    want: Counter = Counter()
    for lang, t in texts:
        for n in (1, 2, 3):
            want.update((lang, t[i : i + n]) for i in range(len(t) - n + 1))
        want.update((lang, f"###{ord(c) // 256}") for c in t)
    assert got == want
    for _, t in texts:
        own = [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)] + [f"###{ord(c) // 256}" for c in t]
        assert sorted(ngrams.codes(t).tolist()) == sorted(map(ngrams.code_of, own))


def test_fit_is_the_model_by_hand(spark):
    docs = spark.createDataFrame([(1, "one  One\n two", "aa"), (2, "drei vier", "bb"), (3, "five", "aa"), (4, "no label", None), (5, None, "bb")], "doc_id long, text string, lang string")
    m = ngrams.fit(docs, kept=1000)
    counts: Counter = Counter()
    for lang, t in (("aa", "one one two"), ("aa", "five"), ("bb", "drei vier")):
        counts.update((lang, k) for k in ngrams.codes(t).tolist())
    want = ngrams.Model.of(counts)
    assert m.languages == want.languages == ["aa", "bb"] and (m.keys == want.keys).all() and np.allclose(m.weights, want.weights)
    few = ngrams.fit(docs, kept=3, per_language=1)
    assert len(few.keys) == 3
    assert ngrams.fit(docs.where("lang is null")).judge("any text that is long enough to be judged") == ("en", 1.0)


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    train = F.md5(F.col("doc_id").cast("string")) < "8"
    m = ngrams.fit(docs.where(train))
    rest = docs.where(~train & (F.length(F.trim("text")) > 100) & F.col("lang").isNotNull()).select("lang", language.detect(F.lit(""), F.col("text"), m)["lang"].alias("found"))
    r = rest.agg(F.avg((F.col("lang") == F.col("found")).cast("int")).alias("share"), F.count("*").alias("n")).first()
    assert r.n > 40 and r.share > 0.95
