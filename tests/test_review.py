"""Probing again, marks and rules, and the loop of both."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.operators import review
from waymark.operators.store import Store
from waymark.plans.address_book import address_book
from waymark.operators.relational import flagged
from waymark.sources.fetch import Offline, Response

from .test_operators import H, discoveries, rows_of

GOOD = b"<html><head><title>Test blog</title></head><body><p>A blog post with archive and comments. Posted by admin. Read more posts in the blog archive of this month.</p></body></html>"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=4)


def flags_of(store):
    book = address_book(store.read("discoveries"), store.read("routers"), store.read("leasesets"))
    return rows_of(flagged(book), "dns_name"), {r.dns_name: r.needs_review for r in book.collect()}


def seed(spark, store, *names, **more):
    store.write("discoveries", discoveries(spark, *[{"ident_hash_hex": H[i], "i2p_dns_name": n, "needs_review": 1, "probed_at": 1.0, **more} for i, n in enumerate(names)]))


def test_cleared_on_success_and_kept_on_failure(spark, store):
    seed(spark, store, "blog.i2p", "down.i2p", deep_analysis="kept")
    assert flags_of(store)[0] == [("blog.i2p",), ("down.i2p",)]

    def web(url):
        return Response(200, GOOD, {"Content-Type": "text/html; charset=utf-8"}) if "blog" in url else Response(502, b"")

    got = review.reprobe(store, web, 100.0)
    assert got == {"probed": 2, "answered": 1, "failed": 1, "cleared": 1}
    left, book = flags_of(store)
    assert left == [("down.i2p",)] and book["blog.i2p"] == 0 and book["down.i2p"] == 1
    assert store.read("discoveries").where("deep_analysis = 'kept'").count() == 2
    assert store.versions() == [1, 2]  # probes, discoveries and cleared marks in one commit
    # nothing answers at all
    assert review.reprobe(store, lambda u: Response(), 200.0) == {"probed": 1, "answered": 0, "failed": 1, "cleared": 0}
    assert flags_of(store)[0] == [("down.i2p",)]


def test_limit(spark, store):
    seed(spark, store, "a.i2p", "b.i2p", "c.i2p")
    web = lambda u: Response(200, GOOD, {"Content-Type": "text/html"})
    assert review.reprobe(store, web, 100.0, limit=2)["cleared"] == 2 and len(flags_of(store)[0]) == 1
    assert review.reprobe(store, web, 101.0)["cleared"] == 1 and flags_of(store)[0] == []
    assert review.reprobe(store, web, 102.0) == {"probed": 0, "answered": 0, "failed": 0, "cleared": 0}


def brute_contrast(pages, support, precision):
    n = {True: Counter(), False: Counter()}
    for _, body, flag in pages:
        w = (body or "").lower().split()
        n[bool(flag)].update({m for m in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))] if 4 <= len(m) <= 60})
    both = {m: (n[True][m], n[False][m]) for m in n[True] | n[False]}
    return sorted((m, f, c, f / (f + c)) for m, (f, c) in both.items() if f >= support and f / (f + c) >= precision)


PAGES = [(i, f"Common words here <gizmo-app v{i}> Panel\n of things{' extra mark' if i < 4 else ''}", True) for i in range(8)]
PAGES += [(i, f"common words here and more xgizmo-applet {i}", False) for i in range(10, 16)] + [(20, "other stuff <widget kind> only", True), (21, "OTHER stuff <widget kind> only", True), (22, "other stuff <widget kind> only", True), (23, None, True), (24, "", None), (25, "other place", None)]


@pytest.mark.parametrize("sent", [0, 16 << 20])
def test_contrast(spark, monkeypatch, sent):
    monkeypatch.setattr(review, "BROADCAST_BYTES", sent)
    df = spark.createDataFrame(PAGES, "id int, body string, flagged boolean").repartition(3)
    for support, precision in ((3, 1.0), (2, 0.5), (100, 0.0)):
        got = sorted(map(tuple, review.contrast(df, support, precision).collect()))
        assert got == brute_contrast(PAGES, support, precision)


def test_mine_rules(spark):
    df = spark.createDataFrame(PAGES, "id int, body string, flagged boolean").repartition(3)
    rules = review.mine_rules(df).orderBy("rank").collect()
    assert [(r.support, r.precision, r.covered) for r in rules] == [(8, 1.0, 8), (3, 1.0, 3)]
    low = {i: " ".join((b or "").lower().split()) for i, b, _ in PAGES}
    for r in rules:  # support and precision hold for plain substrings
        hit = [f for i, _, f in PAGES if r.mark in low[i]]
        assert sum(map(bool, hit)) == r.support and r.support / len(hit) == r.precision
    # a word of claimed pages that holds a candidate lowers its precision
    part = [(i, "zgizmo" if i < 3 else "azgizmob", i < 3) for i in range(6)]
    assert review.mine_rules(spark.createDataFrame(part, "id int, body string, flagged boolean")).count() == 0
    assert review.mine_rules(spark.createDataFrame(part, "id int, body string, flagged boolean"), precision=0.5).first().precision == 0.5
    assert review.mine_rules(df.where("false")).count() == 0 and review.mine_rules(df, most=1).count() == 1


def test_loop_ends_at_a_fixed_point(spark, store):
    names = [f"odd{i}.i2p" for i in range(4)] + ["never.i2p"]
    store.write("discoveries", discoveries(spark, *[{"ident_hash_hex": f"{i:040X}", "i2p_dns_name": n, "needs_review": 1, "probed_at": 1.0} for i, n in enumerate(names)], {"ident_hash_hex": H[2], "i2p_dns_name": "fine.i2p", "reachable": 1, "content_type": "blog", "probed_at": 1.0}))
    bodies = {f"http://odd{i}.i2p/": f"<html><body>zq-console build {i} zq-status page</body></html>".encode() for i in range(4)}
    got = review.heal(store, Offline(bodies | {"http://fine.i2p/": GOOD}), 100.0)
    assert got[0]["cleared"] == 4 and got[-1]["cleared"] == 0 and len(got) == 2
    assert any(r["support"] == 4 and r["precision"] == 1.0 for r in got[0]["rules"])
    assert flags_of(store)[0] == [("never.i2p",)]
    assert store.read("discoveries").where(F.col("i2p_dns_name").startswith("odd") & (F.col("content_type") == "mined")).count() == 4


def test_marks_by_a_bitmap(spark, monkeypatch):
    """The marks of claimed pages are looked for by a bitmap of any size, even one that nearly all marks pass."""
    rows = [(i, " ".join(f"word{(i * k) % 37}" for k in range(1, 12)), i % 3 == 0) for i in range(60)] + [(60, None, False), (61, "word1 word2", None)]
    df = spark.createDataFrame(rows, "id int, body string, flagged boolean")
    has = {i: {m for k, w in enumerate(b.split()) for m in (w, " ".join(b.split()[k : k + 2]))} if b else set() for i, b, _ in rows}
    yes, no = (Counter(m for i, _, f in rows if bool(f) == want for m in has[i]) for want in (True, False))
    want = sorted((m, n, no[m], n / (n + no[m])) for m, n in yes.items() if n >= 2 and n / (n + no[m]) >= 0.3)
    monkeypatch.setattr(review, "BROADCAST_BYTES", 0)
    for bits in (15, 0):
        monkeypatch.setattr(review, "ROW_BITS", bits)
        assert sorted(map(tuple, review.contrast(df, support=2, precision=0.3).collect())) == want and want


def test_search_of_marks(spark):
    """Marks are found inside words and over white space, and none in empty or null texts."""
    listed = ["abcd", "bcde f", "zzzz", "äöüß"]
    df = spark.createDataFrame([("xabcde fg",), ("äöüßabc",), ("",), (None,), ("abc",)], "t string")
    assert [r.h for r in df.select(review.held(F.col("t"), listed).alias("h")).collect()] == [["abcd", "bcde f"], ["äöüß"], [], [], []]
