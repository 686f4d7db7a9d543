"""Store-shaped tables derived from the driver's tables, by the same SQL text in Spark and DuckDB.

SHARED holds expressions that both engines read alike; the few that differ are given per engine.
Each event gives a link; its target is one of twice as many sites as there are users, so half of them are not known yet.
Each customer gives a linked target, with an id below 0, as those of users are not.
Each customer is a router and a lease set; a third of the routers and a fifth of the lease sets have hashes that meet no other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The time at which queries are asked.
NOW = 1706659200.0

#: per engine: epoch of a timestamp, sha1 and sha256 of a text
SPARK = {"EPOCH": "cast(unix_micros(cast(ts as timestamp)) as double) / 1e6", "DIV": "div", "TEXT": "string", "B64": "base64(cast({} as binary))", "LINES": "array_join(transform(array_sort(collect_list(struct(n, line))), x -> x.line), chr(10))"}
DUCK = {"EPOCH": "epoch(ts)", "DIV": "//", "TEXT": "varchar", "B64": "to_base64(encode({}))", "LINES": "string_agg(line, chr(10) ORDER BY n)"}

VIEWS = {
    "raw_probes": """
SELECT event_id AS id, upper(sha1(cast(user_id AS {TEXT}))) AS ident_hash_hex,
  concat(substr(lower(sha1(cast(user_id AS {TEXT}))), 1, 32), '.b32.i2p') AS b32_addr,
  CASE WHEN user_id % 7 = 0 THEN '' ELSE concat('site', cast(user_id AS {TEXT}), '.i2p') END AS i2p_dns_name,
  CASE WHEN event_type IN ('view', 'click') THEN 'b32' ELSE 'dns' END AS probe_mode,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS reachable,
  CASE WHEN event_type <> 'error' THEN 200 ELSE 0 END AS status_code,
  cast(coalesce(length(html), 0) AS bigint) AS body_length, value / 50 AS response_time,
  CASE WHEN event_type IN ('view', 'click') THEN 'b32' ELSE 'dns' END AS via_method,
  CASE WHEN event_type = 'error' OR user_id % 5 = 0 THEN '' ELSE concat('The "', event_type, '" site ', cast(user_id AS {TEXT})) END AS title,
  CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'forum' WHEN 2 THEN 'blog' ELSE 'wiki' END AS content_type,
  CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'en' END AS detected_lang,
  CASE WHEN event_type = 'error' THEN '' WHEN user_id % 3 = 0 THEN concat('Short ', cast(user_id AS {TEXT}))
    WHEN user_id % 11 = 0 THEN concat('Already [ORIGINAL: x] done ', cast(user_id AS {TEXT}))
    ELSE concat('Forum: a page of site ', cast(user_id AS {TEXT}), chr(10), 'Section: everything on ', event_type, chr(10), 'Found some linked sites') END AS content_summary,
  CASE WHEN event_type = 'error' THEN '' ELSE sha1(concat('body', cast(user_id AS {TEXT}))) END AS content_hash, '' AS last_modified,
  CASE WHEN event_type = 'error' OR user_id % 4 = 0 THEN '[]' WHEN user_id % 4 = 1 THEN '["a.i2p"]' ELSE '["a.i2p", "b.i2p", "c.i2p"]' END AS found_links,
  CASE WHEN user_id % 5 = 1 THEN '[{{"type": "tech_stack", "value": "nginx"}}]' ELSE '[]' END AS flags,
  CASE WHEN event_type = 'error' OR user_id % 9 = 0 THEN 1 ELSE 0 END AS needs_review,
  CASE WHEN event_type = 'error' THEN 'timeout' ELSE '' END AS error_msg, {EPOCH} AS probed_at,
  CASE WHEN user_id % 8 = 1 THEN concat('{{"site_type": "forum', chr(92), 'nof notes", "purpose": "talk about ', cast(user_id AS {TEXT}), '", "interest_score": "', cast(user_id % 10 AS {TEXT}), '/10", "interest_reasons": "active"}}')
    WHEN user_id % 8 = 2 THEN concat('{{"site_type": "blog", "purpose": "daily notes of one author", "interest_score": ', cast(user_id % 7 AS {TEXT}), '.9}}') ELSE '' END AS deep_analysis
FROM events LEFT JOIN pages ON page_id = user_id""",
    "discoveries": """
SELECT min_by(id, probed_at) AS id, ident_hash_hex, max_by(b32_addr, probed_at) AS b32_addr, coalesce(max_by(i2p_dns_name, probed_at) FILTER (WHERE i2p_dns_name <> ''), '') AS i2p_dns_name,
  probe_mode, max_by(reachable, probed_at) AS reachable, max_by(status_code, probed_at) AS status_code, max_by(body_length, probed_at) AS body_length,
  max_by(response_time, probed_at) AS response_time, max_by(via_method, probed_at) AS via_method, coalesce(max_by(title, probed_at) FILTER (WHERE title <> ''), '') AS title,
  max_by(content_type, probed_at) AS content_type, max_by(detected_lang, probed_at) AS detected_lang, substr(max_by(content_summary, probed_at), 1, 4096) AS content_summary,
  max_by(content_hash, probed_at) AS content_hash, max_by(last_modified, probed_at) AS last_modified,
  coalesce(max_by(found_links, probed_at) FILTER (WHERE found_links <> '[]'), '[]') AS found_links, coalesce(max_by(flags, probed_at) FILTER (WHERE flags <> '[]'), '[]') AS flags,
  max_by(needs_review, probed_at) AS needs_review, coalesce(max_by(error_msg, probed_at) FILTER (WHERE error_msg <> ''), '') AS error_msg,
  max(probed_at) AS probed_at, max_by(deep_analysis, probed_at) AS deep_analysis
FROM raw_probes GROUP BY ident_hash_hex, probe_mode""",
    "routers": """
SELECT upper(sha1(concat(CASE WHEN c_custkey % 3 = 0 THEN 'router' ELSE '' END, cast(c_custkey AS {TEXT})))) AS ident_hash_hex, cast(floor(abs(c_acctbal)) AS bigint) {DIV} 10 AS bandwidth_kbps,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'XfR' WHEN 'MACHINERY' THEN 'LR' WHEN 'AUTOMOBILE' THEN 'OfR' ELSE 'K' END AS caps
FROM customer""",
    "leasesets": "SELECT upper(sha1(concat(CASE WHEN c_custkey % 5 = 0 THEN 'lease' ELSE '' END, cast(c_custkey AS {TEXT})))) AS ident_hash_hex, cast(c_custkey % 7 AS int) AS num_leases FROM customer",
    "targets": """
SELECT user_id AS id, CASE WHEN user_id % 13 = 0 THEN '' ELSE upper(sha1(cast(user_id AS {TEXT}))) END AS ident_hash_hex,
  concat('site', cast(user_id AS {TEXT}), '.i2p') AS i2p_dns_name, concat(substr(lower(sha1(cast(user_id AS {TEXT}))), 1, 32), '.b32.i2p') AS b32_addr,
  CASE user_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'addressbook' ELSE 'susi_export:main' END AS source, '' AS source_site, '' AS provenance_chain,
  CASE WHEN user_id % 2 = 0 THEN concat('blob-of-a-destination-', cast(user_id AS {TEXT})) ELSE '' END AS dest_data,
  max({EPOCH}) AS last_probed_at, min({EPOCH}) AS first_seen_at, 0e0 AS last_updated_at,
  CASE WHEN user_id % 4 = 0 THEN {NOW}e0 + 3600 ELSE 0e0 END AS backoff_until, CASE WHEN user_id % 8 = 1 THEN {NOW}e0 - 86400 * user_id ELSE 0e0 END AS last_analyzed_at,
  cast(0 AS int) AS susi_active, cast(user_id % 3 AS int) AS consecutive_failures, cast(0 AS int) AS crawl_depth
FROM events GROUP BY user_id
UNION ALL
SELECT -1 - c_custkey, '', concat('link', cast(c_custkey AS {TEXT}), '.i2p'), '', 'linked', concat('site', cast(c_custkey % 50 AS {TEXT}), '.i2p'), '', '', 0e0, 0e0, 0e0, 0e0, 0e0, 0, 0, cast(1 + c_custkey % 3 AS int)
FROM customer""",
    "page_bodies": """
SELECT page_id, concat(html, CASE page_id % 16
  WHEN 0 THEN '<meta name="description" content="A quiet index of hidden places"><p>See one.i2p, two.i2p and three-x.i2p for more.</p>'
  WHEN 1 THEN '<div class="thread">phpBB forum board: 1,204 posts 33 members</div><a href="/t">How to keep the garden alive</a>'
  WHEN 2 THEN '<pre>User-agent: *' || chr(10) || 'Disallow: /private</pre><p>mail admin@hidden.i2p or ops@mail.example.org</p>'
  WHEN 3 THEN '<h2>Menu items</h2><h3>Latest wiki changes</h3><script src="vue.js"></script>'
  WHEN 4 THEN '<form><input type="password" name="p"></form><p>Please use the account manager</p>'
  WHEN 5 THEN '<p>Store: buy hardware and software for 12.50 usd or 3 btc from vendor #17 and vendor #18</p>'
  WHEN 6 THEN '<p>Index of /pub parent directory a.zip b.iso c.pdf mirror</p>'
  WHEN 7 THEN '<p>icecast radio stream mount="/live" stream.mp3</p>'
  WHEN 8 THEN '<p>github.com/someone t.co twitter.com/other</p><!-- wp-content/themes -->'
  WHEN 9 THEN '<p>a1.i2p b2.i2p c3.i2p d4.i2p e5.i2p f6.sub.i2p</p>'
  WHEN 10 THEN '<p>-----BEGIN PGP PUBLIC KEY BLOCK----- contact our form</p>'
  WHEN 11 THEN '<p>swagger-ui openapi dashboard</p>'
  ELSE '' END) AS html
FROM pages""",
    "headed_pages": """
SELECT page_id, concat(CASE page_id % 8
  WHEN 0 THEN '<META  content=x Generator = "Maker 1.2 > all"><meta author=''A. Writer''>'
  WHEN 1 THEN '<meta application-name=Reader author="">'
  WHEN 2 THEN '<meta name="generator" content="not by attribute"><a href="/wp-content/x">Powered by phpBB</a>'
  WHEN 3 THEN '<meta/generator=one generator="two"/><meta generator><i>ember-auto-id</i>'
  WHEN 4 THEN '<meta author="no end'
  WHEN 5 THEN '{{"json": 1}}' ELSE '' END, html) AS html
FROM pages""",
    "hosts_lines": """
SELECT c_nationkey AS path, 2 * c_custkey AS n, concat('# site', cast(c_custkey AS {TEXT}), '.i2p: ', lower(substr(sha1(cast(c_custkey AS {TEXT})), 1, 20)), '.b32.i2p') AS line FROM customer WHERE c_acctbal > 3000
UNION ALL
SELECT c_nationkey, 2 * c_custkey + 1, concat('name', cast(c_custkey AS {TEXT}), '.i2p=', CASE WHEN c_acctbal > 0 THEN {BLOB} ELSE '!' END, CASE WHEN c_acctbal > 5000 THEN '#!sig=abc' ELSE '' END) FROM customer""",
    "hosts_files": "SELECT concat('hosts-', cast(path AS {TEXT})) AS path, {LINES} AS value FROM hosts_lines GROUP BY path",
    "links": """
SELECT DISTINCT concat('site', cast(user_id AS {TEXT}), '.i2p') AS source_site, concat('site', cast((user_id * 7 + event_id) % (SELECT 2 * (max(user_id) + 1) FROM events) AS {TEXT}), '.i2p') AS target_site
FROM events""",
}
_TABLES = "events pages customer documents conversations labels".split()


def view_sql(name: str, engine: dict[str, str]) -> str:
    return VIEWS[name].format(NOW=NOW, BLOB=engine["B64"].format("concat('destination of ', c_name, ' ', c_name)"), **engine)


def needs(name: str) -> list[str]:
    """The tables and views that a view reads."""
    return [t for t in (*_TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS.get(name, ""))]


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The derived tables of a data folder, with the views that they need."""
    made: dict[str, DataFrame] = {}
    tag = "_" + "".join(c if c.isalnum() else "_" for c in sf_dir)

    def make(name: str) -> DataFrame:
        if name in made:
            return made[name]
        if name in _TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            text = view_sql(name, SPARK)
            for t in needs(name):
                # views have names of their own for each folder, so that sessions can be shared
                make(t).createOrReplaceTempView(t + tag)
                text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {t}{tag}", text)
            made[name] = spark.sql(text)
        return made[name]

    return [make(n) for n in names]


def ctes(*names: str) -> str:
    """The WITH clause that defines the views in DuckDB."""
    return "WITH " + ",\n".join(f"{v} AS ({view_sql(v, DUCK)})" for v in VIEWS if not names or v in names)
