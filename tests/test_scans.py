"""Hosts scans over many tasks, backoff without a hot log, meta tags: against plain code."""

import base64
import hashlib
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from waymark.operators import backoff, extractors
from waymark.sources import hosts

from .test_operators import rows_of


def plain_hosts(lines):
    name = address = None
    for i, line in enumerate(lines):
        m = re.match(hosts.HEADER, line)
        if m:
            name, address = m[1].strip() or name, m[2].strip() or address
        elif not line.startswith("#") and "=" in line:
            own, _, rest = line.partition("=")
            blob = rest.split("#!sig=")[0].strip()
            try:
                raw = base64.b64decode(blob.translate(str.maketrans("~-", "/+")), validate=True)
            except ValueError:
                continue
            if blob:
                h = raw[:20].hex().upper()
                b32 = address or (base64.b32encode(bytes.fromhex(h)).decode().lower() + ".b32.i2p" if len(h) == 40 else "")
                yield i, name or own.strip(), h, b32, len(raw)


def hosts_lines(n, heads):
    r = random.Random(n)
    for i in range(n):
        if r.random() < heads:
            yield f"# head{i}.i2p: {'q' * 10}{i}.b32.i2p"
        else:
            yield r.choice([f"n{i}.i2p={base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()}", f"n{i}.i2p=!!", "", "# a comment", f"n{i}=" + base64.b64encode(b"short").decode() + "#!sig=x"])


def test_a_long_file_spreads_over_tasks(spark, tmp_path):
    lines = list(hosts_lines(300_000, 0.00002)) + ["# last: x.b32.i2p"] + ["z.i2p=" + base64.b64encode(bytes(30)).decode()] * 3
    (tmp_path / "hosts.txt").write_text("\r\n".join(lines[:1000]) + "\n" + "\n".join(lines[1000:]) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = hosts.read_hosts(spark, str(tmp_path / "hosts.txt"))
        assert spark.read.text(str(tmp_path / "hosts.txt")).rdd.getNumPartitions() > 4 and got.select("block").distinct().count() > 4
        cols = ("i2p_dns_name", "ident_hash_hex", "b32_raw", "dest_data_len")
        assert [tuple(r[c] for c in cols) for r in got.orderBy("block", "pos").collect()] == [x[1:] for x in plain_hosts(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("block", [3, 50_000])
def test_texts_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(hosts, "BLOCK_LINES", block)
    texts = {f"p{k}": list(hosts_lines(60, 0.1 * k)) for k in range(5)} | {"none": [""]}
    df = spark.createDataFrame([*[(p, "\n".join(x)) for p, x in texts.items()], ("null", None)], "path string, value string")
    got = rows_of(hosts.parse_hosts(df), "path", "pos", "i2p_dns_name", "ident_hash_hex", "b32_raw", "dest_data_len")
    assert got == sorted((p, *x) for p, lines in texts.items() for x in plain_hosts(lines))


def test_backoff_has_no_window(spark):
    r = random.Random(3)
    rows = [(r.choice([None, "", "a", "b", "hot", "hot", "hot"]), r.choice([0, 0, 1, None]), float(r.randrange(40))) for _ in range(400)] + [("failing", 0, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "ident_hash_hex string, reachable int, probed_at double").repartition(4)
    state = backoff.backoff_state(df)
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    want = {}
    for k in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == k]
        ok = max((t for _, up, t in own if up == 1), default=None)
        n, last = sum(up == 0 and (ok is None or t > ok) for _, up, t in own), max(t for *_, t in own)
        want[k] = (n, last + [0, 300, 1800, 7200, 43200, 604800, 604800][min(n, 6)] if n else 0.0, last) if n > 1 or n == 0 else (n, None, last)
    got = {x.ident_hash_hex: (x.consecutive_failures, x.backoff_until, x.last_probed_at) for x in state.collect()}
    assert got.keys() == want.keys()
    for k, (n, _, last) in want.items():
        assert (got[k][0], got[k][2]) == (n, last) and (got[k][1] > last) == (n > 0)


class Metas(HTMLParser):
    """What an inspection reads: attributes by their names."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            ad = {k.lower(): v or "" for k, v in attrs}
            for name, said in (("generator", "generator"), ("author", "author"), ("application-name", "app_name")):
                if ad.get(name):
                    self.found.append((said, ad[name] if name == "generator" else ad[name][:64]))
                    break


BODIES = [
    '<meta generator="A 1"><META  author = \'B "x" > y\' charset=utf8 />', "<meta application-name=Reader author=''>", '<meta name="generator" content="by name">', '<metadata generator="no"><meta generator="late" generator="first">',
    '<meta content="a>b" generator=plain><meta author="Tom &amp; Co">', '<meta author="no end', "<meta generator><meta author=x>", "", f'<meta author="{"z" * 100}">', '<meta\n\tgenerator\n=\n"two lines\nof it">', "no tags", '<p generator="x"><meta/generator="slash">',
]


def test_meta_tags(spark):
    def padded(b):
        return b + " " * (7 * len(b) + 10)  # the tags are within the first part

    rows = spark.createDataFrame([(i, padded(b)) for i, b in enumerate(BODIES)] + [(99, None), (100, BODIES[0])], "i int, b string")
    got = {r.i: [tuple(m) for m in r.m] if r.m is not None else None for r in rows.select("i", extractors.meta_tags(F.col("b")).alias("m")).collect()}
    for i, b in enumerate(BODIES):
        p = Metas()
        p.feed(padded(b)[: min(int(len(padded(b)) * 0.15), 4096)])
        if "late" in b:  # of repeated names the last counts here
            assert got[i] == [("generator", "first")]
            continue
        assert got[i] == p.found, b
    assert not got[99] and got[100] == []
    all_ = rows.where("i = 0").select(extractors.metas(F.col("b")).alias("m")).first().m
    assert all_[1] == {"author": 'B "x" > y', "charset": "utf8"}
