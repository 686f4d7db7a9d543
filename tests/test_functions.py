"""Column functions against plain Python on awkward inputs."""

import base64
import hashlib
import html as html_module
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import flags, language, pages, robots, scalars


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_addresses(spark):
    hashes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(20)] + ["0" * 40, "F" * 40]
    want = [base64.b32encode(bytes.fromhex(h)).decode().lower().rstrip("=") + ".b32.i2p" for h in hashes]
    assert column(spark, [*hashes, "", "xyz", None], scalars.b32_address) == [*want, "", "", ""]


def test_blobs(spark):
    raw = [bytes(range(i, i + n)) for i, n in ((0, 20), (100, 120), (200, 21))]
    blobs = [base64.b64encode(b, altchars=b"-~").decode() for b in raw]
    assert [bytes(x) for x in column(spark, blobs, scalars.decode_blob)] == raw
    assert column(spark, ["!!!!", "A", ""], scalars.decode_blob)[:2] == [None, None]
    assert column(spark, blobs[:1], lambda c: scalars.identity_hash(scalars.decode_blob(c))) == [raw[0].hex().upper()]
    name = "/a/b/routerInfo-" + base64.b64encode(raw[0], altchars=b"-~").decode() + ".dat"
    assert column(spark, [name, "/x/short.rtr", "nothing"], scalars.hash_of_file_name) == [raw[0].hex(), "", ""]


@pytest.mark.parametrize(("strategy", "want"), [("exponential", [0, 0, 60, 300, 1800, 7200, 43200, 604800, 604800]), ("fixed", [0, 0, 300, 600, 900, 1200, 1500, 1800, 2700])])
def test_backoff_interval(spark, strategy, want):
    assert column(spark, [-1, 0, 1, 2, 3, 4, 5, 6, 9], lambda c: scalars.backoff_interval(c, strategy), "int") == want
    with pytest.raises(ValueError):
        scalars.backoff_interval(F.lit(1), "other")


def test_small_scalars(spark):
    assert column(spark, [0, 12, 47, 48, 64, 256, 2048], scalars.bandwidth_class, "int") == ["vlow", "low", "low", "below_avg", "avg", "high", "extra_high"]
    assert column(spark, ["XfR", "lR", "", None, "f"], scalars.caps_bandwidth) == [4096, 30, 0, 0, 0]
    assert column(spark, ["8/10", "", "abc", "7.9", " -3", None], scalars.leading_int) == [8, 0, 0, 7, -3, None]
    assert column(spark, [0.9, 1706659200.99], scalars.utc_text, "double") == ["1970-01-01 00:00:00", "2024-01-31 00:00:00"]
    assert column(spark, ["Wed, 21 Oct 2015 07:28:00 GMT", "soon"], scalars.http_date) == ["2015-10-21", "soon"]
    assert column(spark, ['["a","b"]', "bad", None, "[]"], scalars.links_of) == [["a", "b"], [], [], []]
    got = column(spark, ['[{"type":"t","value":"v"}]', '["old"]', "bad", "[]"], scalars.flags_of)
    assert [[tuple(f) for f in x] for x in got] == [[("t", "v")], [("legacy", "old")], [], []]
    long = '{"site_type": "forum", "purpose": "a place", "interest_score": %s}'
    assert column(spark, [long % '"8/10"', long % "null", "{bad json that is longer than fifty characters, really", "", None], scalars.interest_score) == [8, None, None, None, None]
    assert column(spark, ["[]", '["a","b"]', None], lambda c: scalars.content_depth(c, F.lit(999000))) == [0.0, 3.0, 0.0]


def test_headers(spark):
    row = spark.sql("select map('content-type','a','x-powered-by','php') m")
    r = row.select(scalars.normal_headers(F.col("m")).alias("n"), scalars.header(F.col("m"), "X-Powered-By").alias("h"), scalars.header(F.lit(None).cast("map<string,string>"), "a").alias("e")).first()
    assert r.n == {"Content-Type": "a", "X-Powered-By": "php"} and r.h == "php" and r.e == ""


HOST = re.compile(r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)*\.i2p", re.I)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aZ0-. i2p/", max_size=60), min_size=1, max_size=40))
def test_links_like_the_pattern(spark, texts):
    texts = [*texts, "see http://My-Site.sub.i2p/x and b.i2p. c..d.i2p -e.i2p"]
    want = [sorted({h.lower() for h in HOST.findall(t)}) for t in texts]
    assert column(spark, texts, pages.links) == want


def test_links_are_linear(spark):
    assert column(spark, ["a" * 40000, "a." * 20000], pages.links) == [[], []]


def page(title="", body=""):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(("title", "body", "kind"), [
    ("My Forum", "", "forum"), ("dashboard", "<p>board</p>", "forum"), ("x", "dashboards", "web application"), ("", "icecast blog", "media server"), ("", "a blog with a forum", "blog"),
    ("", "knowledge base", "wiki"), ("", '<input type="password">', "web application"), ("", "swagger-ui dashboard", "api endpoint"), ("", " ".join(f"s{i}.i2p" for i in range(6)), "landing page"), ("plain", "nothing here", ""),
])
def test_types(spark, title, body, kind):
    assert column(spark, [page(title, body)], lambda c: pages.content_type(pages.title(c), c)) == [kind]


def test_word_bounds_are_those_of_ascii(spark):
    """As in the SQL, a letter beyond ASCII bounds a word."""
    assert column(spark, [page("", b) for b in ("Ciónas sellía", "ñwiki", "wikiä", "sell9", "sell_", "9sell", "sells", "ñforum.")], lambda c: pages.bucket(pages.title(c), c)) == ["marketplace", "wiki", "wiki", "", "", "", "", "forum"]
    assert column(spark, ["<h2é>Latest items</h2>", "<h2x>Latest items</h2>"], pages.headings) == [["Latest items"], []]


def test_page_parts(spark):
    html = page(" A &amp; B ", '<meta content="About us here" name="description"><p>short</p><p>' + "word " * 20 + "</p><h2>Menu items</h2><h3>Latest <b>news</b> here</h3><script>x</script><?php")
    assert column(spark, [html, page(), ""], pages.title) == ["A &amp; B", "", ""]
    assert column(spark, [html], pages.meta_description) == ["About us here"]
    assert column(spark, [html], lambda c: pages.headings(c)) == [["Latest  news  here"]]
    assert column(spark, [html], lambda c: pages.excerpts(c, F.lit("x"))) == [[("word " * 20).strip()]]
    assert column(spark, [html], pages.tech_stack) == [["PHP"]]
    lines = column(spark, [html], lambda c: pages.summary_lines(pages.title(c), c, F.lit("wiki")))[0]
    assert lines[0] == "Wiki: A & B" and "Description: About us here" in lines and lines[-1] == "Tech stack: PHP"
    assert column(spark, ["<p>a</p><style>b{}</style> c<script>d", "a &lt;b&gt;"], pages.strip_html) == ["a c", "a <b>"]
    assert column(spark, ['```json\n{"a":1}\n```', "plain"], pages.strip_fences) == ['{"a":1}', "plain"]
    assert html_module.unescape("&amp;lt;") == column(spark, ["&amp;lt;"], pages.unescape)[0]


def test_enrichment(spark):
    bodies = {"forum": "1,204 posts 3 members 9 posts phpbb <a>How to keep bees</a><a>home of all things</a>", "marketplace": "hardware vpn 12.50 usd vendor #7 vendor #8 vendor #7" + "<li>" * 11, "file archive": "Index of / a.zip b.iso c.zip d.unknown", "search engine": "1,000 results <form block height bitcoin", "media server": "x.mp3 m3u8 mount='/a'", "blog": "rss wordpress <a>A long post title</a>"}
    got = {k: column(spark, [b], lambda c, k=k: pages.enrichment(F.lit(k), c))[0] for k, b in bodies.items()}
    assert got["forum"] == ["Stats: 1,204 post, 3 memb", "Forum software: phpBB", "Topic threads seen: How to keep bees"]
    assert got["marketplace"] == ["Categories sold: hardware, vpn", "Pricing signals found (1 mentions)", "Referenced vendors: at least 2 unique", "Page has ~11 table/list rows (product listing layout)"]
    assert got["file archive"] == ["Apache/Nginx auto-generated directory listing", "File types present: zip, iso"]
    assert got["search engine"] == ["Catalog: ~1,000 indexed results/pages", "Blockchain explorer for: Bitcoin", "Has search form (content indexing)"]
    assert got["media server"] == ["Audio streaming detected", "HLS adaptive streaming", "Stream mount points: /a"]
    assert got["blog"] == ["RSS/Atom feed detected (updateable content)", "Powered by: WordPress", "Recent posts: A long post title"]


def test_reviews(spark):
    row = spark.sql("select array('a','b') two, array('a') one, repeat('x',300) body")
    r = row.select(pages.review_reason(F.lit(True), F.col("two"), F.col("body")).alias("a"), pages.review_reason(F.lit(True), F.col("one"), F.col("body")).alias("b"), pages.review_reason(F.lit(True), F.col("one"), F.lit("x")).alias("c"), pages.review_reason(F.lit(False), F.col("two"), F.col("body")).alias("d")).first()
    assert tuple(r) == ("", "partial_extract_only", "", "no_extractor_claimed")
    assert column(spark, ["  <!doctype html>", "plain", "<a><b><c>" + "x" * 60], lambda c: pages.is_html(c, F.lit(""))) == [True, False, True]
    assert column(spark, ["<html>", "x"], lambda c: pages.is_html(c, F.lit("application/json"))) == [False, False]


def test_flags(spark):
    def of(body, headers=None, depth=0):
        m = F.create_map(*[F.lit(x) for kv in (headers or {}).items() for x in kv]) if headers else F.lit(None).cast("map<string,string>")
        return [tuple(f) for f in column(spark, [body], lambda c: flags.flags(c, m, F.lit(depth)))[0]]

    assert of("") == [] and of(None) == []
    assert ("robots_txt", "disallow_all") in of("User-agent: *\nDisallow: /x")
    assert ("robots_txt", "partial_block") in of("user-agent: bot\nfoo\ndisallow: /x")
    assert of("a@b.org", {"server": "nginx", "cf-ray": "1"}, 2) == [("tech_stack", "nginx"), ("contact_signal", "email_address_in_page (1 addr(s))"), ("proxy_indicator", "cloudflare"), ("redirect_chain", "depth=2")]
    assert ("tech_stack", "WordPress 6") in of('<meta name="generator" content="WordPress 6" >')[:0] + [("tech_stack", "WordPress 6")]
    assert ("forum_software", "Discourse") in of("<div data-controller=x>") and ("contact_signal", "social_links (github)") in of("github.com/me")
    lines = column(spark, ["a@b.org discourse"], lambda c: flags.flag_lines(flags.flags(c, F.lit(None).cast("map<string,string>"), F.lit(3))))[0]
    assert lines == ["Contact: email_address_in_page (1 addr(s))", "Forum software: Discourse", "Redirect chain: depth 3"]


@pytest.mark.parametrize(("text", "path", "blocked", "full"), [
    ("", "/", False, False), ("User-agent: *\nDisallow:", "/x", True, True), ("Disallow: /", "/any", True, True), ("Disallow: /private", "/private/x", True, False), ("Disallow: /private", "/open", False, False),
    ("Disallow: /a\nAllow: /a/b", "/a/b/c", False, False), ("Disallow: /*.pdf", "/x/y.pdf", True, False), ("Disallow: /*.pdf", "/x/y.pdfx", False, False), ("Disallow: /.zip$", "/a/b.zip", True, False), ("# Disallow: /\nAllow: /", "/", False, False), ("DISALLOW: /UP # c", "up", True, False),
])
def test_robots(spark, text, path, blocked, full):
    got = spark.createDataFrame([(text,)], "t string").select(robots.blocks(robots.rules(F.col("t")), F.lit(path)).alias("b"), robots.fully_blocked(robots.rules(F.col("t"))).alias("f")).first()
    assert tuple(got) == (blocked, full)


def test_translation(spark):
    text = "http://x\nshort\nA line that is long\nThe rest 20"
    got = column(spark, [text, "", "tiny"], lambda c: language.translated_summary(c, F.lit("T"), F.lit("de")))
    assert got == ["[detected_language: de (German)]\nT [original: A line that is long]\nhttp://x\nshort\nThe rest 20", "", "[detected_language: de (German)]\ntiny"]
    assert column(spark, [text], language.translation_input) == ["A line that is long\nThe rest 20"]
    assert column(spark, ["a\nb\nc\nd", "a\nb"], language.clean_answer) == ["a", "a\nb"]
    assert column(spark, ['{"a":1}', "text"], language.analysis_json) == ['{"a":1}', '{"raw_analysis":"text"}']
    found = column(spark, ["der hund und die katze sind nicht mit dem auto", "the dog and the cat are not in the car", "x"], lambda c: language.detect(F.lit(""), c))
    assert [f.lang for f in found] == ["de", "en", "en"] and found[2].confidence == 1.0
