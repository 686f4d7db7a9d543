"""Merges, queries, crawl, sources, extractors, store and streaming on small tables."""

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.operators import backoff, crawl, export, extractors, merge, relational
from waymark.operators.probe import sweep
from waymark.operators.store import Store
from waymark.plans import oracle, queries
from waymark.plans.address_book import COLUMNS, address_book
from waymark.plans.derived import load
from waymark.sources import console, fetch, hosts, records
from waymark.streaming import jobs

H = ["A" * 40, "B" * 40, "C" * 40]
EMPTY = {"string": "", "bigint": 0, "int": 0, "double": 0.0}


def table(spark, schema, rows):
    kinds = spark.createDataFrame([], schema).dtypes
    return spark.createDataFrame([tuple(r.get(c, EMPTY[t]) for c, t in kinds) for r in rows], schema)


def discoveries(spark, *rows):
    return table(spark, schemas.DISCOVERIES, [{"found_links": "[]", "flags": "[]", "probe_mode": "b32", "id": i} | r for i, r in enumerate(rows)])


def targets(spark, *rows):
    return table(spark, schemas.TARGETS, [{"id": i} | r for i, r in enumerate(rows)])


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_keeps_what_is_not_empty(spark):
    old = discoveries(spark, {"ident_hash_hex": H[0], "title": "Old", "i2p_dns_name": "a.i2p", "status_code": 200, "probed_at": 5.0, "deep_analysis": "kept", "found_links": '["x"]'}, {"ident_hash_hex": H[1], "probed_at": 1.0})
    new = discoveries(spark, {"ident_hash_hex": H[0], "status_code": 500, "probed_at": 3.0, "content_summary": "s" * 5000, "id": 9}, {"ident_hash_hex": H[0], "probe_mode": "dns", "id": 10}).drop("deep_analysis")
    got = {(r.ident_hash_hex, r.probe_mode): r for r in merge.upsert_discoveries(old, new).collect()}
    assert len(got) == 3
    r = got[H[0], "b32"]
    assert (r.title, r.i2p_dns_name, r.status_code, r.found_links, r.deep_analysis, r.id, len(r.content_summary)) == ("Old", "a.i2p", 500, '["x"]', "kept", 0, 4096)
    twice = merge.upsert_discoveries(merge.upsert_discoveries(old, new), new)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, got.values()))


def test_rows_without_hash_stay_apart(spark):
    new = discoveries(spark, {"i2p_dns_name": "a.i2p"}, {"i2p_dns_name": "b.i2p"}, {"i2p_dns_name": "a.i2p"})
    assert merge.fold_probes(new).count() == 2


def test_hosts_tables(spark):
    old = table(spark, schemas.ROUTERS, [{"ident_hash_hex": H[0], "i2p_dns_name": "n", "source": "first", "bandwidth_kbps": 1}])
    new = table(spark, schemas.ROUTERS, [{"ident_hash_hex": H[0], "source": "second", "bandwidth_kbps": 2}, {"ident_hash_hex": H[1], "source": "second"}])
    assert rows_of(merge.upsert_routers(old, new), "ident_hash_hex", "i2p_dns_name", "source", "bandwidth_kbps") == [(H[0], "n", "first", 2), (H[1], "", "second", 0)]
    a = table(spark, schemas.LEASESETS, [{"ident_hash_hex": H[0], "num_leases": 1, "file_size": 7}])
    b = table(spark, schemas.LEASESETS, [{"ident_hash_hex": H[0], "num_leases": 3, "file_size": 9}])
    assert rows_of(merge.upsert_leasesets(a, b), "num_leases", "file_size") == [(3, 7)]


def test_targets_merge(spark):
    t = targets(spark, {"ident_hash_hex": H[0], "source": "addressbook"}, {"i2p_dns_name": "a.i2p", "source": "manual", "provenance_chain": "seed.i2p → a.i2p"}, {"i2p_dns_name": "s.i2p", "source": "susi_export:main", "susi_active": 3})
    more = merge.insert_targets(t, t.select("ident_hash_hex", "i2p_dns_name").unionByName(spark.createDataFrame([(H[1], ""), (H[1], "")], "ident_hash_hex string, i2p_dns_name string")), "addressbook", 9.0)
    assert rows_of(more, "ident_hash_hex", "i2p_dns_name", "source", "last_updated_at") == [("", "a.i2p", "manual", 0.0), ("", "s.i2p", "susi_export:main", 0.0), (H[0], "", "addressbook", 9.0), (H[1], "", "addressbook", 9.0)]
    seeds = spark.createDataFrame([("b.i2p", "a.i2p"), ("b.i2p", "z.i2p"), ("", "a.i2p"), ("a.i2p", "b.i2p"), ("c.i2p", "q.i2p"), ("d.i2p", "")], "i2p_dns_name string, source_site string")
    got = merge.seed_links(t, seeds, 2)
    assert rows_of(got, "i2p_dns_name", "provenance_chain", "crawl_depth", "source") == [("b.i2p", "seed.i2p → a.i2p → b.i2p", 2, "linked"), ("c.i2p", "q.i2p → c.i2p", 2, "linked"), ("d.i2p", "d.i2p", 2, "linked")]
    entries = spark.createDataFrame([("", "a.i2p", "BLOB"), (H[2], "n.i2p", "X"), (H[2], "", "X")], "ident_hash_hex string, i2p_dns_name string, dest_b64 string")
    got = merge.import_entries(t, entries, "router", 4, 1.0)
    assert rows_of(got, "i2p_dns_name", "source", "susi_active") == [("", "addressbook", 0), ("a.i2p", "susi_export:router", 4), ("n.i2p", "susi_export:router", 4), ("s.i2p", "susi_export:main", 0)]
    catalog = spark.createDataFrame([(H[0].lower(),)], "ident_hash_hex string")
    judged, seen = merge.reconcile(more, catalog, 5.0)
    assert rows_of(judged.where("ident_hash_hex <> ''"), "ident_hash_hex", "source", "last_updated_at") == [(H[0], "addressbook", 5.0), (H[1], "addressbook:stale", 9.0)]
    assert seen.get == {"kept": 1, "stale": 1}


def test_maintenance(spark):
    d = discoveries(spark, {"ident_hash_hex": H[0], "reachable": 0, "probed_at": 0.0, "needs_review": 1}, {"ident_hash_hex": H[0], "reachable": 1, "probed_at": 1.0, "needs_review": 1}, {"ident_hash_hex": H[1], "reachable": 0, "probed_at": 1e6})
    assert rows_of(merge.cleanup(d, 1e6), "id") == [(1,), (2,)]
    assert rows_of(merge.clear_review(d, H[0]), "id", "needs_review") == [(0, 1), (1, 0), (2, 0)]
    assert rows_of(merge.keep_last_id(d), "id") == [(1,), (2,)]
    one, done = merge.update_analysis(d, targets(spark, {"ident_hash_hex": H[0]}, {"ident_hash_hex": H[1]}), spark.createDataFrame([(H[0], "new")], "ident_hash_hex string, analysis string"), 7.0)
    assert rows_of(one, "id", "deep_analysis") == [(0, "new"), (1, "new"), (2, "")] and rows_of(done, "ident_hash_hex", "last_analyzed_at") == [(H[0], 7.0), (H[1], 0.0)]
    assert rows_of(merge.update_summaries(d, spark.createDataFrame([(1, "t")], "id long, content_summary string")), "id", "content_summary") == [(0, ""), (1, "t"), (2, "")]


@pytest.mark.parametrize(("ups", "failures", "wait"), [([0], 1, 60), ([0, 0], 2, 300), ([0, 1, 0], 1, 60), ([1], 0, 0), ([0] * 8, 8, 604800), ([0, 0, 1], 0, 0)])
def test_backoff(spark, ups, failures, wait):
    p = discoveries(spark, *[{"ident_hash_hex": H[0], "reachable": u, "probed_at": float(i)} for i, u in enumerate(ups)])
    at = len(ups) - 1.0
    assert rows_of(backoff.backoff_state(p), "consecutive_failures", "backoff_until") == [(failures, at + wait if failures else 0.0)]
    t = targets(spark, {"ident_hash_hex": H[0], "consecutive_failures": 2}, {"ident_hash_hex": H[1], "consecutive_failures": 5})
    total = failures if 1 in ups else failures + 2
    assert rows_of(backoff.apply_backoff(t, p), "id", "consecutive_failures", "last_probed_at") == [(0, total, at), (1, 5, 0.0)]


def test_address_book(spark):
    analysis = json.dumps({"site_type": "a\nb", "purpose": "p" * 300, "interest_score": "7/10", "interest_reasons": "r"})
    d = discoveries(
        spark, {"ident_hash_hex": H[0], "b32_addr": "x.b32.i2p", "i2p_dns_name": "a.i2p", "reachable": 1, "probed_at": 2.0, "title": 'T "q"', "content_summary": "line one of it\nline two of the summary", "body_length": 2048, "response_time": 1.25, "detected_lang": "de", "deep_analysis": analysis, "found_links": '["a","b"]'},
        {"ident_hash_hex": H[0], "i2p_dns_name": "a.i2p", "probed_at": 1.0}, {"ident_hash_hex": H[1], "b32_addr": "y.b32.i2p", "probed_at": 1.0, "reachable": 1, "deep_analysis": "{broken" + "x" * 60}, {"ident_hash_hex": H[2], "b32_addr": "z.b32.i2p", "reachable": 0, "title": "t"},
    )
    r = table(spark, schemas.ROUTERS, [{"ident_hash_hex": H[0], "bandwidth_kbps": 90, "caps": "f"}])
    ls = table(spark, schemas.LEASESETS, [{"ident_hash_hex": H[0], "num_leases": 5}])
    book = {x.dns_name: x for x in address_book(d, r, ls).collect()}
    a = book["a.i2p"]
    assert list(a.asDict()) == COLUMNS and len(book) == 3
    assert a.content_summary == "a.i2p (\"T 'q'\") [unknown] (originally de) 2KB in 1.3s — line one of it · line two of the summary"
    assert (a.deep_site_type, len(a.deep_purpose), a.interest_score, a.stability_index, a.content_depth, a.deep_analyzed_at) == ("a· b", 200, 7, 200.0, 0.48, "1970-01-01 00:00:02")
    assert book["y.b32.i2p"].content_summary == "y.b32.i2p (no content data)" and book["y.b32.i2p"].interest_score is None
    assert book["z.b32.i2p"].content_summary == "z.b32.i2p — currently unreachable"
    page = export.browse_page(address_book(d, r, ls), relational.timeline(d), relational.reachability_series(d))
    assert "a.i2p" in page and export.report(address_book(d, r, ls)).startswith("# Catalog report\n- 3 destinations, 2 reachable, 1 unreachable")
    assert len(json.loads(export.book_json(address_book(d, r, ls), 2))) == 2
    with pytest.raises(ValueError):
        relational.flagged(address_book(d, r, ls), -1)


def test_queue(spark):
    t = targets(spark, {"ident_hash_hex": H[0], "last_probed_at": 50.0}, {"ident_hash_hex": H[1], "last_probed_at": 10.0}, {"i2p_dns_name": "n.i2p"}, {"i2p_dns_name": "m.i2p", "backoff_until": 1e9}, {"ident_hash_hex": H[2]})
    d = discoveries(spark, {"ident_hash_hex": H[0], "reachable": 1}, {"i2p_dns_name": "n.i2p", "reachable": 1}, {"ident_hash_hex": H[1]})
    order = lambda **k: [r.ident_hash_hex[:1] or r.i2p_dns_name for r in relational.target_queue(t, d, now=100.0, **k).collect()]
    assert order() == ["A", "C", "B", "n.i2p"] and order(skip_backoff=False)[-1] == "m.i2p" and order(mode="reachable_only") == ["A", "n.i2p"]
    assert order(mode="never_probed") == ["C", "n.i2p"] and order(mode="stale", min_age_hours=0.02) == ["C", "B", "n.i2p"] and order(limit=1) == ["A"]
    with pytest.raises(ValueError):
        order(mode="other")
    with pytest.raises(ValueError):
        relational.pending_analyses(d, t, "other")
    a = spark.createDataFrame([("http://x.i2p/a",), (H[0].lower(),), ("b.b32.i2p",)], "address string")
    assert rows_of(relational.normalise_addresses(a), "ident_hash_hex", "i2p_dns_name") == [("", "b.b32.i2p"), ("", "x.i2p"), (H[0], "")]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "a"), ("c", "c"), ("d", "")], "source_site string, target_site string")
    seeds = spark.createDataFrame([("a",)], "site string")
    assert rows_of(crawl.crawl(seeds, links, 2), "site", "depth", "provenance_chain") == [("a", 0, "a"), ("b", 1, "a → b"), ("c", 1, "a → c"), ("d", 2, "a → c → d")]
    assert crawl.crawl(seeds, links, 5, max_new=1).count() == 3
    assert crawl.crawl_delay(10, 3) == 20


def test_hosts_file(spark, tmp_path):
    blobs = [base64.b64encode(bytes(range(i, i + 40)), altchars=b"-~").decode() for i in range(3)]
    (tmp_path / "hosts.txt").write_text(f"# head\na.i2p={blobs[0]}#!sig=x\n\n# b.i2p: {'q' * 52}.b32.i2p\nother={blobs[1]}\nnext={blobs[2]}\nempty=\nbad=!!!\n")
    got = hosts.read_hosts(spark, str(tmp_path / "hosts.txt"))
    assert [(r.i2p_dns_name, r.dest_data_len, r.ident_hash_hex[:4]) for r in got.orderBy("pos").collect()] == [("a.i2p", 40, "0001"), ("b.i2p", 40, "0102"), ("b.i2p", 40, "0203")]
    h = bytes(range(1, 21)).hex()
    assert hosts.blob_of(got, h).first().dest_b64 == blobs[1]


def router_bytes(style=1, port=1234):
    address = bytes([style]) + bytes([10, 0, 0, 1]) + b"s" * 32 + b"i" * 32 + struct.pack("<HQB", port, 5000, 1)
    return b"\x01" + b"k" * 32 + struct.pack(">I", 3) + b"crt" + struct.pack("<Q", 1700000000500) + b"<caps><value>XfR</value>" + address + b"\x00sig"


def test_records(spark, tmp_path):
    r = records.parse_router(router_bytes())
    assert (r["key_type"], r["version"], r["caps"], r["bandwidth_kbps"], r["options_mask"], r["published"]) == (1, 1700000000, "XfR", 4096, 1, 1)
    assert r["transports"] == [{"ip": "10.0.0.1", "port": 1234, "protocol": "NTCP2", "published": True, "created_at": 5.0}]
    for junk in (b"", b"\x00", b"\x01" * 10, bytes(range(256)) * 20):
        records.parse_router(junk), records.parse_lease_set(junk)
    lease = b"g" * 20 + b"tagt" + struct.pack(">H", 5) + b"12345" + b"e" * 64 + struct.pack("<Q", 9)
    data = b"\x03" + bytes(range(20)) + struct.pack("<Q", 7000) + b"\x01" + struct.pack(">HH", 5, 2) + lease * 2 + struct.pack(">H", 1) + b"v" * 104 + b"sig"
    want = {"hash": bytes(range(20)).hex(), "store_type": 3, "num_leases": 2, "options_mask": 5, "leases_v1_count": 1, "created_at": 7.0}
    assert records.parse_lease_set(data).items() >= want.items() and records.parse_lease_set(base64.b64encode(data)).items() >= want.items()
    name = base64.b64encode(bytes(range(30, 50)), altchars=b"-~").decode()
    (tmp_path / "sub").mkdir()
    (tmp_path / f"{name}.rtr").write_bytes(router_bytes())
    (tmp_path / "sub" / f"{name}.rtr").write_bytes(router_bytes(2))
    (tmp_path / "junk.rtr").write_bytes(b"x")
    (tmp_path / "a.ls64").write_bytes(data)
    rt, ls = records.read_catalog(spark, str(tmp_path))
    assert rows_of(rt, "ident_hash_hex", "options_mask") == [(bytes(range(30, 50)).hex().upper(), 4)]
    assert rows_of(ls, "ident_hash_hex", "num_leases") == [(bytes(range(20)).hex().upper(), 2)]


def test_console(spark):
    name = base64.b64encode(bytes(range(20)), altchars=b"-~").decode()
    pages = spark.createDataFrame([(f"<a>{'ab' * 20}</a> x{'cd' * 21} {name}", "peers")], "html string, kind string")
    assert rows_of(console.stub_routers(pages), "ident_hash_hex") == [(bytes(range(20)).hex().upper(),), ("AB" * 20,)]
    td = lambda cells: "".join(f"<td>{c}</td>" for c in cells)
    peers = [""] * 50
    peers[20], peers[26], peers[28], peers[32] = "12 / 20", "7", "900", "2 tunnels"
    page = spark.createDataFrame([(td(["Version", "2.0", "Uptime", "5 min 1 sec", "Rate", "3.5 / 4 KBps"]), td(peers)), ("", "")], "home string, peers string")
    got = sorted(console.health(page).collect(), key=lambda r: r.version)
    assert (got[0].state, got[0].is_ready) == ("down", False)
    r = got[1]
    assert (r.uptime_seconds, r.in_kbps, r.peers_connected, r.netdb_known, r.floodfills, r.state, r.is_ready) == (301, 3.5, 12, 900, 7, "ready", True) and r.readiness == pytest.approx(0.84)


def test_fetching(spark, tmp_path):
    offline = fetch.Offline({"http://a.i2p/": b"<title>A</title>", "http://a.i2p/robots.txt": b"Disallow: /"})
    got = fetch.fetch_paths(spark.createDataFrame([("a.i2p",)], "host string"), offline)
    assert rows_of(got.where("status = 200"), "url", "body_length") == [("http://a.i2p/", 16), ("http://a.i2p/robots.txt", 11)] and got.count() == 15
    policies = {r.host: r.policy for r in fetch.robots_policies(spark.createDataFrame([("a.i2p",), ("a.i2p",), ("b.i2p",)], "host string"), offline).collect()}
    assert policies["a.i2p"][0].is_disallow and policies["b.i2p"] is None and len(policies) == 2

    def broken(url):
        raise OSError("down")

    assert rows_of(fetch.fetch(spark.createDataFrame([("x",)], "url string"), broken), "status", "error") == [(0, "down")]
    assert not fetch.network_up(spark, broken, ["x"]) and fetch.network_up(spark, offline, ["x"])
    calls = []
    retry = fetch.Retrying(lambda u: calls.append(u) or fetch.Response(), attempts=3, base=0.0, rest_after=1)
    assert retry("u").status == 0 and len(calls) == 3 and retry("u").error.startswith("resting") and len(calls) == 3
    (tmp_path / "t.json").write_text(json.dumps({"targets": [{"url": "http://a.i2p/x.html", "name": "A"}, {"name": "none"}, {"url": "http://b.i2p/page.html"}]}))
    assert rows_of(fetch.load_targets(spark, str(tmp_path / "t.json")), "label", "url") == [("A", "http://a.i2p/x.html"), ("page", "http://b.i2p/page.html")]
    assert fetch.prompt("<{{BODY}}>", spark.createDataFrame([("b",)], "body string")).first().prompt == "<b>"


def test_sweep(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("discoveries").count() == 0
    store.write("targets", targets(spark, {"i2p_dns_name": "a.i2p", "source": "manual"}, {"i2p_dns_name": "gone.i2p", "source": "manual"}))
    web = fetch.Offline({"http://a.i2p/": b"<html><title>A forum</title> see b.i2p <a>x</a></html>", "http://b.i2p/": b"<html><title>B wiki</title></html>"})
    seen = sweep(store, web, 1000.0, crawl_depth=1)
    assert rows_of(seen, "i2p_dns_name", "reachable") == [("a.i2p", 1), ("b.i2p", 1), ("gone.i2p", 1)] or rows_of(seen, "i2p_dns_name", "status_code") == [("a.i2p", 200), ("b.i2p", 200), ("gone.i2p", 404)]
    assert rows_of(store.read("discoveries"), "i2p_dns_name", "content_type")[:2] == [("a.i2p", "forum"), ("b.i2p", "wiki")]
    assert rows_of(store.read("targets"), "i2p_dns_name", "source", "last_probed_at") == [("a.i2p", "manual", 1000.0), ("b.i2p", "linked", 1000.0), ("gone.i2p", "manual", 1000.0)]


class Claims:
    priority = 10

    def can_handle(self, body, headers, status):
        return headers.get("X-Kind") == "mine"

    def extract(self, title, body, headers):
        return "mine", ["line", title], []


class Fails(Claims):
    priority = 1

    def extract(self, title, body, headers):
        raise RuntimeError


def test_extractors(spark, tmp_path):
    (tmp_path / "plug.py").write_text("class P:\n    priority = 5\n    def can_handle(self, b, h, s): return 'plug' in b\n    def extract(self, t, b, h): return 'plug', ['p'], ['x.i2p']\ndef register(r): r.register(P)\n")
    (tmp_path / "_skip.py").write_text("raise SystemExit")
    reg = extractors.Registry([Claims(), Fails(), extractors.propose("r", "rule", ["MARK"])]).discover(tmp_path)
    pages = spark.createDataFrame([("t", "b", {"x-kind": "mine"}, 200), ("t", "a plug " + "x" * 300, {}, 200), ("", "has mark", {}, 200), (None, None, None, None)], "title string, body string, headers map<string,string>, status int")
    got = {r.extractor: r for r in extractors.run_plugins(pages, reg).collect()}
    assert got["Claims"].summary_lines == ["line", "t"] and got["P"].review_reason == "partial_extract_only" and got["RuleExtractor"].content_type == "rule" and got[""].review_reason == "no_extractor_claimed"
    assert extractors.RuleExtractor.from_json(extractors.propose("n", "k", ["a"]).to_json()).marks == ["a"]
    assert extractors.valid_source("x = 1") and not extractors.valid_source("x =")
    with pytest.raises(ValueError):
        extractors.propose("n", "k", [])
    body = spark.createDataFrame([("<table><table><form><form><a>/wp-content/" + "x" * 600,)], "b string")
    r = body.select(extractors.frameworks(F.col("b")).alias("f"), extractors.structure(F.col("b")).alias("s"), extractors.detected_type(F.col("b"), F.lit("")).alias("t"), extractors.page_form(F.lit('{"a"')).alias("p")).first()
    assert r.f[0].name == "WordPress" and r.s == ["table_heavy", "form_based"] and r.t == "wordpress" and r.p == "json_api"


def test_streams(spark, tmp_path):
    rows = [{"ident_hash_hex": H[i % 2], "reachable": int(i % 3 == 0), "probed_at": 3600.0 * i, "status_code": i, "title": "T" if i < 2 else ""} for i in range(8)]
    d = discoveries(spark, *rows).drop("deep_analysis")
    d.where("id < 5").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        jobs.stream_upserts(source, store, str(tmp_path / "cp")).awaitTermination()
        d.where("id >= 5").write.mode("append").parquet(str(tmp_path / "in"))
    jobs.stream_upserts(source, store, str(tmp_path / "cp")).awaitTermination()
    assert rows_of(store.read("discoveries"), "ident_hash_hex", "status_code", "title") == [(H[0], 6, "T"), (H[1], 7, "T")]
    spark.createDataFrame(d.limit(0).rdd, d.schema)
    q = jobs.stream_series(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("series").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("series").count() == 8
    assert jobs.wait(0) == 0 and jobs.wait(2) == 300 and jobs.wait(99) == 604800 and jobs.wait(3, "fixed") == 900


def test_stream_backoff(spark, tmp_path):
    d = discoveries(spark, *[{"ident_hash_hex": H[0], "reachable": u, "probed_at": float(i)} for i, u in enumerate([1, 0, 0])])
    d.write.parquet(str(tmp_path / "in"))
    q = jobs.stream_backoff(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("waits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.table("waits"), "consecutive_failures", "backoff_until") == [(2, 302.0)]


def test_plans_have_no_nested_loops(spark, small):
    for name in ("address_book", "targets_reachable", "targets_all", "link_seed_antijoin", "reachability_hourly"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


DUCK = ["address_book", "targets_reachable", "reachability_daily", "flags_explode", "backoff_exponential", "lang_tag_summary", "link_extract", "link_seed_chains", "crawl_depth_stats", "probe_urls", "file_name_hashes", "http_dates", "translation_inputs"]


@pytest.mark.parametrize("name", DUCK)
def test_like_the_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in "events pages customer documents conversations labels".split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(oracle.oracle()[name])
    cols = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in cols]
    show = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    want = sorted(show([r[i] for i in order]) for r in want.fetchall())
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == cols and sorted(show(r) for r in got.select(*cols).collect()) == want


def links_of_all_events(spark, folder):
    """(source, target) of each event, without the view's SQL."""
    events = [(r.user_id, r.event_id) for r in spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id").collect()]
    sites = 2 * (max(u for u, _ in events) + 1)
    return {(f"site{u}.i2p", f"site{(7 * u + e) % sites}.i2p") for u, e in events}, {f"site{u}.i2p" for u, _ in events}


def test_links_of_all_events(spark, small):
    """Every event is a link; the crawl and the new targets against brute force over all of them."""
    links, known = links_of_all_events(spark, small)
    assert set(map(tuple, load(spark, small, "links")[0].collect())) == links
    found = {s: (0, "", s) for s, _ in links if s in ("site1.i2p", "site2.i2p")}
    for depth in (1, 2, 3):
        ways = {}
        for s, t in links:
            if s in found and found[s][0] == depth - 1 and t not in found:
                ways[t] = min(ways.get(t, (s,)), (s,))
        found |= {t: (depth, s, f"{found[s][2]} → {t}") for t, (s,) in ways.items()}
    assert rows_of(queries.QUERIES["link_graph_bfs"](spark, small), "site", "depth", "source_site", "provenance_chain") == sorted((k, *v) for k, v in found.items())
    new = {t: min(s for s, x in links if x == t) for _, t in links if t not in known}
    assert new and rows_of(queries.QUERIES["link_seed_antijoin"](spark, small), "i2p_dns_name", "source_site", "provenance_chain") == sorted((t, s, f"{s} → {t}") for t, s in new.items())


def test_targets_of_all_customers(spark, small):
    """Every customer is a linked target with an id of its own, and all of a depth are candidates."""
    folder = small.replace("sf0.001", "sf0.01")
    keys = [r.c_custkey for r in spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey").collect()]
    t = load(spark, folder, "targets")[0]
    assert rows_of(t.where("source = 'linked'"), "i2p_dns_name") == sorted((f"link{k}.i2p",) for k in keys)
    assert t.select("id").distinct().count() == t.count()
    want = sorted((f"link{k}.i2p", f"site{k % 50}.i2p") for k in keys if k % 3 == 1)
    assert rows_of(queries.QUERIES["crawl_candidates_all"](spark, folder), "i2p_dns_name", "source_site") == want
    assert queries.QUERIES["targets_never"](spark, folder).count() >= len(keys)


def test_catalog_of_all_customers(spark, small):
    """Every customer is a router and a lease set; some of either kind meet no other."""
    n = spark.read.parquet(f"{small}/customer.parquet").count()
    assert queries.QUERIES["caps_bandwidth"](spark, small).count() == n
    routers, leases = (load(spark, small, v)[0].select("ident_hash_hex") for v in ("routers", "leasesets"))
    assert routers.distinct().count() == leases.distinct().count() == n
    assert 0 < routers.join(leases, "ident_hash_hex", "left_anti").count() < n and 0 < leases.join(routers, "ident_hash_hex", "left_anti").count() < n


def test_every_query_runs(spark, small):
    for name, q in queries.QUERIES.items():
        assert q(spark, small).limit(3).collect() is not None, name
