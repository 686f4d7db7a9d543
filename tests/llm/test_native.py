"""Exact dedup, URL filters and mixing: brute force on small tables with every awkward case."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.llm import common
from waymark.llm.exact_dedup import exact_dedup
from waymark.llm.mixing import mix_sources, targets
from waymark.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, source string, id string, text_sha256 string, size int, key string, bucket int"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1, "k", 2) for i, t, s in rows], SCHEMA)


AWKWARD = [(1, None, "a"), (2, "", "a"), (3, "Same Text", "b"), (4, "same text", None), (4, "same text", None), (5, "SAME tExt", "b"), (6, "É a", "b"), (7, "é a", "b"), (None, "same text", "c"), (None, "only null id", "c"), (8, "long " * 30000, "a"), (9, "LONG " * 30000, "a"), (10, "a\x00b", "d"), (11, "a", "d")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("buckets", [1, 2, 12])
def test_exact_dedup(spark, keep, buckets):
    rows = AWKWARD + [(100 + i, "hot copy", "h") for i in range(300)]
    got = exact_dedup(docs(spark, rows).repartition(5), keep=keep, buckets=buckets, carry=True).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    assert len(got) == len(rows)
    for r in got:
        own = groups[low(r.row.text)]
        ids = [i for i in own if i is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        assert (r.keep_id, r.group_size, r.text_sha256) == (best, len(own), hashlib.sha256(low(r.row.text).encode()).hexdigest())
        assert not r.kept or r.id == best
    kept = Counter(low(r.row.text) for r in got if r.kept)
    assert kept == {t: 1 for t in groups}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_of_one_row_without_id(spark):
    from waymark.llm import exact_dedup as module

    rows = [(None, "The same", "a")] * 3000 + [(1, "the SAME", "a")] * 2000 + [(2, "another", "b")]
    df = docs(spark, rows).repartition(5)
    keys = module.settled(df).select(module._key(F.lower("text"), F.monotonically_increasing_id()).alias("key")).groupBy("key").count().agg(F.max("count")).first()[0]
    assert keys < 50
    got = exact_dedup(df, buckets=12).collect()
    assert len(got) == 5001 and {(r.keep_id, r.group_size) for r in got} == {(1, 5000), (2, 1)}
    assert sum(r.kept for r in got) == 2


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
    host = low(host)
    best = None
    for rule, action in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, best and best[0], best[1] if best else default


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://Example.COM/en/71?x=1#f", "http://a.example.com/en/8", "http://example.com/EN/7", "ftp://x.net/de/9", "http://example.net/de/80", "http://b.example.net/de/8", "http://notexample.net/de/8",
            "http://org/es/", "http://.org/es/x", "http://com", "http://a..com/en/", "http://h.com?/en/", "http://u@x.com:80/en/", "http://x.com/en", "http://é.com/en/é", "http://x.com/en/" + "y" * 50000, "a://b://c.com/en/"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = filter_urls(df, spark.createDataFrame(RULES, "rule string, action string")).collect()
    assert sorted((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *verdict(u, RULES)) for i, u in enumerate(urls))
    none = filter_urls(df, spark.createDataFrame([], "rule string, action string"), default="block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}
    assert filter_urls(df.limit(0), spark.createDataFrame(RULES, "rule string, action string")).count() == 0


def water(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        t = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in order if x not in full) for s in order}
        more = {s for s in order if s not in full and t[s] > most * sizes[s]}
        if not more:
            return t
        full |= more


def test_mixing(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randint(1, 5) for _ in range(int(rnd.paretovariate(1) * 5) % 900)), rnd.choice(["big"] * 6 + ["a", "B", "é", None, "tiny"])) for i in range(900)]
    rows += [(5000 + i, "one two three four five", "hot") for i in range(400)] + [(9001, None, "void"), (9002, "", "void"), (None, "x y", "a"), (7, "x y z", "a"), (7, "x y z", "a")]
    df = docs(spark, rows)
    got = mix_sources(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()), key=str)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 5, s


def test_mixing_of_repeated_rows(spark):
    from waymark.llm import mixing

    rows = [(1, "a b c", "hot")] * 3000 + [(None, "d e f", "hot")] * 1500 + [(i, "w " * (i % 9), "other") for i in range(2, 900)]
    found = [mix_sources(docs(spark, rows).repartition(n)).collect() for n in (3, 8)]
    assert sorted(map(tuple, found[0]), key=str) == sorted(map(tuple, found[1]), key=str)
    want = water({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("hot", "other")})
    for s, t in want.items():
        assert abs(sum(r.taken for r in found[0] if r.source == s) - t) <= 0.01 * t + 5
    df = common.cut(docs(spark, rows).repartition(4).select(F.xxhash64("doc_id", "text").alias("h"), F.spark_partition_id().alias("place")))
    lots = mixing._numbered(df).groupBy("h", "lot").count().collect()
    assert sum(r["count"] for r in lots) == len(rows) and max(r["count"] for r in lots) == mixing.RANKED


def test_mixing_of_nothing(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    assert [tuple(r)[4:] for r in mix_sources(docs(spark, [(1, None, None), (2, "", None)])).collect()] == [(0.0, 0, 0)] * 2


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, None: 3}, {"a": 0, "b": 5}, {"x": 1000, "y": 1, "z": 1, "zz": 2, "zzz": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(str(s), s, n, 1) for s, n in sizes.items()], "key string, source string, source_size long, docs long")
    assert {r.source: r.target for r in targets(df).collect()} == pytest.approx(water(sizes))
