"""DuckDB SQL for the engine's queries, over the driver's tables."""

from __future__ import annotations

from .derived import NOW, ctes

_BOOK = """, keyed AS (SELECT *, CASE WHEN i2p_dns_name <> '' THEN i2p_dns_name ELSE b32_addr END AS k FROM discoveries),
ranked AS (SELECT *, max(nullif(b32_addr, '')) OVER (PARTITION BY k) AS b32, max(nullif(i2p_dns_name, '')) OVER (PARTITION BY k) AS dns,
  row_number() OVER (PARTITION BY k ORDER BY probed_at DESC, id DESC) AS rn FROM keyed),
deep AS (SELECT ident_hash_hex, strftime(make_timestamp(cast(floor(max(probed_at)) AS bigint) * 1000000), '%Y-%m-%d %H:%M:%S') AS deep_analyzed_at FROM discoveries WHERE length(deep_analysis) > 50 GROUP BY ident_hash_hex),
ab AS (SELECT ranked.* REPLACE (b32 AS b32_addr), coalesce(dns, b32) AS dns_name, length(coalesce(deep_analysis, '')) > 50 AS has_deep FROM ranked WHERE rn = 1),
wide AS (SELECT ab.*, r.bandwidth_kbps, r.caps AS router_caps, ls.num_leases, deep.deep_analyzed_at FROM ab
  LEFT JOIN routers r USING (ident_hash_hex) LEFT JOIN leasesets ls USING (ident_hash_hex) LEFT JOIN deep USING (ident_hash_hex)),
kb AS (SELECT *, CASE WHEN body_length > 0 THEN regexp_replace(cast(round(body_length / 1024.0::DOUBLE, 3) AS varchar), '\\.0$', '') ELSE '' END AS kbt,
  concat(dns_name, ' ("', replace(title, '"', ''''), '") [', coalesce(nullif(content_type, ''), 'unknown'), ']') AS base FROM wide),
book AS (SELECT dns_name, content_type, reachable, strftime(make_timestamp(cast(floor(probed_at) AS bigint) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_probed_utc,
  CASE WHEN reachable = 0 THEN dns_name || ' — currently unreachable'
    WHEN coalesce(title, '') <> '' AND length(content_summary) > 30 THEN concat(base, CASE WHEN length(detected_lang) = 2 AND detected_lang <> 'en' THEN concat(' (originally ', detected_lang, ')') ELSE '' END,
      ' ', kbt, 'KB in ', cast(round(coalesce(response_time, -1.0), 1) AS varchar), 's — ', substr(replace(replace(content_summary, chr(10), ' · '), chr(13), ''), 1, 200))
    WHEN coalesce(title, '') <> '' THEN base
    WHEN length(content_summary) > 10 THEN concat(dns_name, ' — ', substr(replace(content_summary, chr(10), ' · '), 1, 200))
    ELSE dns_name || ' (no content data)' END AS content_summary,
  CASE WHEN has_deep THEN trim(replace(json_extract_string(deep_analysis, '$.site_type'), chr(10), '· ')) END AS deep_site_type,
  CASE WHEN has_deep THEN replace(substr(json_extract_string(deep_analysis, '$.purpose'), 1, 200), chr(10), ' · ') END AS deep_purpose,
  deep_analyzed_at, ident_hash_hex, b32_addr, status_code, body_length, title, response_time AS response_time_sec, detected_lang, via_method, probed_at AS last_probed_at,
  content_hash, last_modified, found_links, flags, needs_review,
  CASE WHEN has_deep AND json_extract_string(deep_analysis, '$.interest_score') IS NOT NULL THEN coalesce(try_cast(regexp_extract(replace(json_extract_string(deep_analysis, '$.interest_score'), 'null', ''), '^\\s*([+-]?\\d+)', 1) AS int), 0) END AS interest_score,
  CASE WHEN has_deep THEN json_extract_string(deep_analysis, '$.interest_reasons') END AS interest_reasons,
  round(CASE WHEN found_links = '[]' OR coalesce(body_length, 0) <= 0 THEN 0.0 ELSE (1 + (length(found_links) - length(replace(found_links, ',', ''))) // 2) * log10(1 + greatest(body_length, 1) / 1000.0::DOUBLE) END, 2) AS content_depth,
  round(CASE WHEN response_time IS NULL OR response_time <= 0 THEN 0.0 ELSE coalesce(bandwidth_kbps, 0) * coalesce(num_leases, 0) / (response_time + 1.0::DOUBLE) END, 2) AS stability_index,
  deep_analysis, bandwidth_kbps, router_caps, num_leases FROM kb)
"""
_UTC = "strftime(make_timestamp(cast(floor(probed_at) AS bigint) * 1000000), '%Y-%m-%d %H:%M:%S')"
_QUEUE = "(SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM discoveries d WHERE d.ident_hash_hex = t.ident_hash_hex AND d.ident_hash_hex <> '' AND d.reachable = 1) THEN 0 ELSE 1 END AS up_rank, CASE WHEN length(t.ident_hash_hex) = 40 THEN 0 ELSE 1 END AS hash_rank FROM targets t)"
_QUEUE_COLUMNS = "ident_hash_hex, i2p_dns_name, up_rank, hash_rank, last_probed_at"
_EVER = "EXISTS (SELECT 1 FROM discoveries d WHERE d.reachable = 1 AND ((t.ident_hash_hex <> '' AND d.ident_hash_hex = t.ident_hash_hex) OR (t.ident_hash_hex = '' AND d.i2p_dns_name = t.i2p_dns_name)))"
_FAILS = """, ok AS (SELECT *, max(CASE WHEN reachable = 1 THEN probed_at END) OVER (PARTITION BY ident_hash_hex) AS last_ok FROM raw_probes),
state AS (SELECT ident_hash_hex, cast(count(*) FILTER (WHERE reachable = 0 AND (last_ok IS NULL OR probed_at > last_ok)) AS int) AS f, max(probed_at) AS seen FROM ok GROUP BY ident_hash_hex)"""
_TRANSLATABLE = "reachable = 1 AND detected_lang NOT IN ('', 'en') AND content_summary NOT ILIKE '%[original:%'"
_LOW = "lower(substr(html, 1, 32768))"
_TITLE = "trim(regexp_extract(substr(html, 1, 8000), '(?is)<title[^>]*>(.*?)</title>', 1))"
_PLAIN = "trim(regexp_replace(regexp_replace(substr(html, 1, 32764), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_LINKS = r"""list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all(lower(substr(html, 1, 32768)), '([a-z0-9.\-]+)', 1), lambda r: contains(r, '.i2p')),
  lambda r: string_split_regex(r, '\.\.|-\.|\.-'))), lambda p: regexp_extract(regexp_replace(p, '^[.\-]+', ''), '^(.*\.i2p)', 1)), lambda h: length(h) > 4)))"""


def _bucket() -> str:
    from ..functions.pages import BUCKETS, bucket_pattern

    t, b = f"lower({_TITLE})", _LOW
    ways = " ".join(f"WHEN regexp_matches({t}, '{p}') OR regexp_matches({b}, '{p}') THEN '{n}'" for n, p in ((n, bucket_pattern(w).replace("\\ ", " ")) for n, w in BUCKETS.items()))
    return f"CASE {ways} ELSE '' END"


def _flag_rows() -> str:
    from ..functions.flags import EMAIL, FORUMS, SYSTEMS

    part, low = "substr(html, 1, 32768)", _LOW
    made = "trim(regexp_extract(substr(html, 1, 32768), '(?i)<meta[^>]+name=[\"'']?generator[\"'']?\\s+content=[\"'']([^\"'']+)[ \"'']', 1))"
    systems = ", ".join(f"CASE WHEN regexp_matches({part}, '(?i){p}') THEN '{n}' END" for n, p in SYSTEMS.items())
    forums = " UNION ALL ".join(f"SELECT page_id, 'forum_software' AS type, '{n}' AS value FROM page_bodies WHERE regexp_matches({low}, '{p}')" for n, p in FORUMS.items())
    mails = f"len(regexp_extract_all({part}, '{EMAIL}'))"
    pgp = "<[^>]+content=[\"'']application/pgp-keys[\"'']|-----BEGIN PGP PUBLIC KEY BLOCK-----|--begin pgp public key block--|armour.*public.*key|\\.asc\\b.*pgp|gpg.*fingerprint"
    contact = "class[^>]*=\"contact\"|contact.*form|tor.*contact|onion.*contact|idiot\\.onion"
    social = {"twitter": r"(?:twitter\.com|x\.com)/\w+", "mastodon": r"mastodon\.|/\.\w+/@\w+", "github": r"github\.com/\w+", "telegram": r"telegram\.(?:me|org)/\w+"}
    found = ", ".join(f"CASE WHEN regexp_matches({part}, '(?i){p}') THEN '{n}' END" for n, p in social.items())
    robots = f"CASE WHEN regexp_matches({low}, 'user-agent\\s*:\\s*\\*\\s*\\n\\s*disallow\\s*:\\s*/\\s*') THEN 'disallow_all' WHEN contains({low}, 'user-agent') AND contains({low}, 'disallow:') THEN 'partial_block' END"
    return f"""SELECT page_id, type, value FROM (
SELECT page_id, 'robots_txt' AS type, {robots} AS value FROM page_bodies
UNION ALL SELECT page_id, 'tech_stack', array_to_string(list_filter(['nginx', {systems}], lambda x: x IS NOT NULL)[1:5], ', ') FROM page_bodies
UNION ALL SELECT page_id, 'contact_signal', CASE WHEN {mails} > 0 THEN concat('email_address_in_page (', {mails}, ' addr(s))') END FROM page_bodies
UNION ALL SELECT page_id, 'contact_signal', CASE WHEN regexp_matches({part}, '(?i){pgp}') THEN 'pgp_key_found' END FROM page_bodies
UNION ALL SELECT page_id, 'contact_signal', CASE WHEN regexp_matches({low}, '{contact}') THEN 'tor_contact_form' END FROM page_bodies
UNION ALL SELECT page_id, 'contact_signal', concat('social_links (', nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ', '), ''), ')') FROM page_bodies
UNION ALL SELECT page_id, 'proxy_indicator', 'cloudflare' FROM page_bodies
UNION ALL {forums}) WHERE value IS NOT NULL AND value <> 'social_links ()'"""


def _base32() -> str:
    """Base 32 of a 40-digit hash: four numbers of 40 bits, eight digits each."""
    digit = "substr('abcdefghijklmnopqrstuvwxyz234567', cast((v >> {shift}) & 31 AS int) + 1, 1)"
    part = ", ".join(digit.format(shift=35 - 5 * i) for i in range(8))
    return ", ".join(part.replace("v >>", f"('0x' || substr(ident_hash_hex, {1 + 10 * k}, 10))::BIGINT >>") for k in range(4))


def _language() -> str:
    """n-grams of 1 to 3 characters and blocks of 256 code points, counted and weighed in SQL alone."""
    grams = lambda table, keep: " UNION ALL ".join(
        [f"SELECT {keep}, '###' || (unicode(substr(x, i, 1)) // 256) AS gram FROM (SELECT *, unnest(range(1, length(x) + 1)) AS i FROM {table})"]
        + [f"SELECT {keep}, substr(x, i, {n}) AS gram FROM (SELECT *, unnest(range(1, length(x) + 2 - {n})) AS i FROM {table})" for n in (1, 2, 3)]
    )
    return f"""WITH t AS (SELECT doc_id, lang, lower(trim(regexp_replace(concat(' ', substr(coalesce(text, ''), 1, 8192)), '\\s+', ' ', 'g'))) AS x, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, x) AS nth FROM t WHERE lang IS NOT NULL AND h < '8') WHERE nth <= 200),
c AS (SELECT lang, gram, count(*) AS n FROM ({grams("s", "lang")}) GROUP BY ALL),
k AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT 50000),
kc AS (SELECT c.* FROM c JOIN k USING (gram)),
l AS (SELECT lang, sum(n) + (SELECT count(*) FROM k) AS total FROM kc GROUP BY lang),
d AS (SELECT doc_id, gram, count(*) AS m FROM ({grams("t", "doc_id")}) GROUP BY ALL),
hit AS (SELECT doc_id, kc.lang, sum(m * ln(n + 1)) AS s FROM d JOIN kc USING (gram) GROUP BY ALL),
size AS (SELECT doc_id, sum(m) AS m FROM d GROUP BY doc_id),
score AS (SELECT doc_id, l.lang, coalesce(hit.s, 0) - size.m * ln(total) AS s FROM size CROSS JOIN l LEFT JOIN hit USING (doc_id, lang)),
best AS (SELECT doc_id, max(s) AS s, max_by(lang, s) AS lang FROM score GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN length(x) < 30 OR s > -20 THEN 'en' ELSE best.lang END AS lang, CASE WHEN length(x) < 30 OR s <= -50 THEN 1.0::DOUBLE WHEN s <= -20 THEN 0.7 ELSE least(0.4, greatest(0.1, -s / 100)) END AS confidence
FROM t LEFT JOIN best USING (doc_id)"""


def _hosts() -> str:
    """The lines of each text, with the last header above; base 32 of the first 20 bytes where it gives no address."""
    return f"""{ctes("hosts_lines", "hosts_files")},
l AS (SELECT path, unnest(string_split(value, chr(10))) AS line, generate_subscripts(string_split(value, chr(10)), 1) - 1 AS pos FROM hosts_files),
h AS (SELECT *, nullif(regexp_extract(line, '^#\\s*(.+?):\\s+(.+?)\\.b32\\.i2p', 1), '') AS hn, nullif(regexp_extract(line, '^#\\s*(.+?):\\s+(.+?)\\.b32\\.i2p', 2), '') AS ha FROM l),
f AS (SELECT *, last_value(hn IGNORE NULLS) OVER w AS name, last_value(ha IGNORE NULLS) OVER w AS address FROM h WINDOW w AS (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, string_split(substr(line, strpos(line, '=') + 1), '#!sig=')[1] AS blob FROM f WHERE NOT starts_with(line, '#') AND contains(line, '=') AND NOT contains(line, '!')
  UNION ALL SELECT *, string_split(substr(line, strpos(line, '=') + 1), '#!sig=')[1] FROM f WHERE NOT starts_with(line, '#') AND contains(line, '#!sig=') AND NOT contains(line, '=!')),
x AS (SELECT *, upper(substr(hex(from_base64(blob)), 1, 40)) AS ident_hash_hex, octet_length(from_base64(blob)) AS n FROM b)
SELECT path, pos, coalesce(name, split_part(line, '=', 1)) AS i2p_dns_name, ident_hash_hex, coalesce(address, concat({_base32()}, '.b32.i2p')) AS b32_raw, n AS dest_data_len, blob AS dest_b64 FROM x"""


def _fingerprints() -> str:
    marks = {
        "WordPress": "/wp-content/, /wp-includes/", "Drupal": "drupalsettings, views-view", "Joomla": "/components/com_, tmpl=component", "phpBB": "Powered by phpBB, posting.php", "SMF": "Simple Machines Forum, /Themes/",
        "Discourse": "preloaded-user, ember-auto-id", "phpMyAdmin": "pma__, server_variables", "Nextcloud": "/apps/activity/, settings-jar", "ownCloud": "data-owner=, oc-core",
    }
    found = {n: ", ".join(f"CASE WHEN contains(lower(html), lower('{m}')) THEN '{'drupalSettings' if m == 'drupalsettings' else m}' END" for m in ms.split(", ")) for n, ms in marks.items()}
    named = ", ".join(f"CASE WHEN len(list_filter([{x}], lambda x: x IS NOT NULL)) > 0 THEN '{n}: ' || array_to_string(list_filter([{x}], lambda x: x IS NOT NULL), ', ') END" for n, x in found.items())
    first = " ".join(f"WHEN len(list_filter([{x}], lambda x: x IS NOT NULL)) > 0 THEN '{n.lower()}'" for n, x in found.items())
    # an attribute's values in the order of a tag; the last one counts
    value = lambda name: f"list_filter(regexp_extract_all(tag, '(?i)(?:^|[\\s/\"''])({name})(?:\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>\"''][^\\s>]*))?', 2), lambda x: true)[-1]"
    bare = lambda name: f"coalesce(regexp_replace({value(name)}, '^[\"''](.*)[\"'']$', '\\1'), '')"
    form = "CASE WHEN regexp_matches(html, '^[\\[{]') THEN 'json_api' WHEN contains(lower(html), '<rss') OR contains(lower(html), '<feed') THEN 'xml_feed' WHEN contains(lower(html), 'announce') AND contains(lower(html), 'torrent') THEN 'torrent_tracker' ELSE '' END"
    return f"""{ctes("headed_pages")},
m AS (SELECT page_id, generate_subscripts(t, 1) AS i, unnest(t) AS tag FROM (SELECT page_id, regexp_extract_all(substr(html, 1, least(floor(length(html) * 0.15), 4096)::INT), '(?i)<meta([\\s/](?:\"[^\"]*\"|''[^'']*''|[^''\">])*)>', 1) AS t FROM headed_pages)),
v AS (SELECT page_id, i, CASE WHEN {bare("generator")} <> '' THEN 'generator=' || {bare("generator")} WHEN {bare("author")} <> '' THEN 'author=' || {bare("author")}[1:64] WHEN {bare("application-name")} <> '' THEN 'app_name=' || {bare("application-name")}[1:64] END AS said FROM m),
g AS (SELECT page_id, string_agg(said, '|' ORDER BY i) AS said FROM v WHERE said IS NOT NULL GROUP BY page_id),
s AS (SELECT page_id, html, list_transform(regexp_extract_all(substr(html, 1, 4096), '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)) AS t FROM headed_pages),
n AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: x = 'table')) AS tables, len(list_filter(t, lambda x: x = 'form')) AS forms, len(list_filter(t, lambda x: x = 'a')) AS links, length(html) > 512 AND len(t) >= 5 AS enough FROM s)
SELECT n.page_id, array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), '; ') AS frameworks, coalesce(said, '') AS meta_tags, {form} AS form,
  array_to_string(list_filter([CASE WHEN enough AND tables / n > 0.25 THEN 'table_heavy' END, CASE WHEN enough AND forms >= 2 THEN 'form_based' END, CASE WHEN enough AND links > n * 0.3 THEN 'link_dense' END], lambda x: x IS NOT NULL), ',') AS structure,
  CASE {first} WHEN {form} = 'json_api' THEN 'json_api' WHEN {form} = 'xml_feed' THEN 'feed_rss' WHEN contains(lower(html), 'announce') AND contains(lower(html), 'tracker') THEN 'torrent_tracker' ELSE 'unknown' END AS detected_type
FROM n LEFT JOIN g USING (page_id)"""


def oracle() -> dict[str, str]:
    w, b = ctes(), ctes() + _BOOK
    queue = f"{w} SELECT {_QUEUE_COLUMNS} FROM {_QUEUE} t"
    triple = "ident_hash_hex, b32_addr, i2p_dns_name"
    best = f"""{w}, r AS (SELECT *, row_number() OVER (PARTITION BY ident_hash_hex ORDER BY reachable DESC, body_length DESC, response_time, id) AS rn,
      bool_or(probe_mode = 'b32' AND reachable = 1) OVER (PARTITION BY ident_hash_hex) AS by_b32, bool_or(probe_mode = 'dns' AND reachable = 1) OVER (PARTITION BY ident_hash_hex) AS by_dns FROM raw_probes)"""
    fold = "id, ident_hash_hex, b32_addr, i2p_dns_name, probe_mode, reachable, status_code, body_length, response_time, via_method, title, content_type, detected_lang, content_summary, content_hash, found_links, needs_review, error_msg, probed_at"
    interval = "CASE WHEN f = 0 THEN 0.0 ELSE seen + [60, 300, 1800, 7200, 43200, 604800][least(f, 6)] END"
    series = lambda fmt: f"""{w}, s AS (SELECT strftime(make_timestamp(cast(floor(probed_at) AS bigint) * 1000000), '{fmt}') AS ts_utc, count(*) AS total_probes, count(*) FILTER (WHERE reachable = 1) AS reachable, count(*) FILTER (WHERE reachable = 0) AS unreachable FROM raw_probes GROUP BY 1)
SELECT *, cast(round_even(100.0::DOUBLE * reachable / total_probes, 0) AS bigint) AS pct FROM s"""  # noqa: E731
    para = f"""{w}, ps AS (SELECT page_id, {_TITLE} AS title, unnest(list_transform(regexp_extract_all(substr(html, 1, 32768), '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda e: trim(regexp_replace(trim(regexp_replace(e, '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g')))) AS p,
  generate_subscripts(regexp_extract_all(substr(html, 1, 32768), '(?is)<p\\b[^>]*>(.*?)</p>', 1), 1) AS i FROM page_bodies),
h AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda x: x <> '')) AS heads FROM ps),
ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM h WHERE length(p) > 40 AND length(p) < 350
  AND len(list_filter(heads, lambda x: length(x) > 3 AND list_contains(string_split(lower(p), ' '), x))) / greatest(len(heads), 1)::DOUBLE < 0.5)
SELECT page_bodies.page_id, coalesce(string_agg(substr(p, 1, 300), '|' ORDER BY i), '') AS excerpts FROM page_bodies LEFT JOIN ok ON ok.page_id = page_bodies.page_id AND rn <= 2 GROUP BY page_bodies.page_id"""
    heads = f"""{w}, hs AS (SELECT page_id, list_transform(regexp_extract_all(substr(html, 1, 16384), '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]>', 1), lambda e: trim(regexp_replace(e, '<[^>]+>', ' ', 'g'))) AS h FROM page_bodies)
SELECT page_id, coalesce(array_to_string(list_filter(h, lambda x: length(x) > 5 AND length(x) < 200 AND lower(regexp_extract(x, '^\\s*(\\S+)', 1)) NOT IN ('home', 'menu', 'nav', 'navigation', 'sidebar', 'footer'))[1:3], '|'), '') AS headings FROM hs"""
    meta = """coalesce(nullif(regexp_extract(substr(html, 1, 16384), '(?i)<meta[^>]+name=["'']?description["'']?\\s+content=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(substr(html, 1, 16384), '(?i)<meta[^>]+content=["'']([^"'']+)["'']\\s+name=["'']?description["'']?', 1), ''), nullif(regexp_extract(substr(html, 1, 16384), '(?i)<meta[^>]+property=["'']?og:description["'']?\\s+content=["'']([^"'']+)["'']', 1), ''), '')"""
    any_ = lambda words: "(" + " OR ".join(f"contains({_LOW}, '{x}')" for x in words.split(", ")) + ")"
    falls = f"""{w} SELECT page_id, CASE WHEN len({_LINKS}) >= 5 AND len(regexp_extract_all(substr({_PLAIN}, 1, 4096), '[.!?]\\s+')) < 8 THEN 'landing page'
  WHEN {any_("swagger-ui, redoc, openapi, application/json")} OR regexp_matches(substr({_LOW}, 1, 8192), 'content-type.*application/json') THEN 'api endpoint'
  WHEN {any_("dashboard, admin panel, control panel, management interface, statistics dashboard, server status")} OR {any_("account manager, login portal, authentication required, sign in to continue")}
    OR regexp_matches(substr(html, 1, 8192), '(?i)type\\s*=\\s*["'']password["'']') THEN 'web application' ELSE '' END AS kind FROM page_bodies"""
    tech = {"Node.js": "npm|node_modules|express", "Ruby on Rails": "csrf-token|media_types/", "PHP": "<?php", "Python/Django": "django-|csrftoken", "Go": "go_session|gorouter"}
    frames = {"React": "react[-_]?app|__react_events__|data-reactroot", "Angular": r"ng-app|ng-version|angular\.js", "Vue.js": r"vue\.js|data-v-"}
    named = lambda x: ", ".join(f"CASE WHEN regexp_matches({_LOW}, '{p}') THEN '{n}' END" for n, p in x.items())
    blob = "max_by(dest_data, id) FILTER (WHERE length(dest_data) > 0 AND i2p_dns_name <> '')"
    lang = "coalesce(nullif(detected_lang, ''), (SELECT max_by(d.detected_lang, d.probed_at) FROM discoveries d WHERE d.ident_hash_hex = book.ident_hash_hex), '')"
    return {
        "address_book": f"{b} SELECT * FROM book",
        "address_book_limit": f"{b} SELECT dns_name, reachable, content_depth, stability_index FROM book ORDER BY dns_name LIMIT 25",
        "latest_probes_by_hash": f"{w} SELECT id, probe_mode, status_code, {_UTC} AS probed_at_utc FROM raw_probes WHERE ident_hash_hex = upper('356a192b7913b04c54574d18c28d46e6395428ab') ORDER BY probed_at DESC, id DESC LIMIT 10",
        "latest_probes_by_dns": f"{w} SELECT id, probe_mode, status_code, {_UTC} AS probed_at_utc FROM raw_probes WHERE i2p_dns_name = 'site2.i2p' ORDER BY probed_at DESC, id DESC LIMIT 10",
        "summary_stats": f"{w} SELECT count(*) AS discoveries, count(DISTINCT ident_hash_hex) AS destinations, cast(coalesce(sum(reachable), 0) AS bigint) AS reachable, (SELECT count(*) FROM routers) AS routers, (SELECT count(*) FROM leasesets) AS leasesets FROM discoveries",
        "duplicate_rows": f"{w} SELECT count(*) - count(DISTINCT ident_hash_hex || '_' || probe_mode) AS duplicates FROM raw_probes",
        "flagged": f"{b} SELECT ident_hash_hex, coalesce(dns_name, '') AS dns_name, coalesce(content_type, '') AS content_type, coalesce(title, '') AS title, coalesce(flags, '') AS flags, coalesce(found_links, '') AS found_links FROM book WHERE needs_review = 1",
        "targets_all": queue,
        "targets_reachable": f"{queue} WHERE {_EVER}",
        "targets_never": f"{queue} WHERE last_probed_at <= 0",
        "targets_stale": f"{queue} WHERE last_probed_at < {NOW} - 86400",
        "targets_skip_backoff": f"{queue} WHERE backoff_until <= {NOW}",
        "crawl_candidates": f"{w} SELECT id, i2p_dns_name, source_site, crawl_depth FROM targets WHERE source = 'linked' AND crawl_depth = 2 AND last_probed_at = 0 ORDER BY id LIMIT 20",
        "crawl_candidates_all": f"{w} SELECT id, i2p_dns_name, source_site, crawl_depth FROM targets WHERE source = 'linked' AND crawl_depth = 2 AND last_probed_at = 0",
        "pending_analysis_reachable": f"{w} SELECT {triple}, min(CASE WHEN length(coalesce(deep_analysis, '')) = 0 THEN 0 ELSE 1 END) AS rank, max(probed_at) AS probed_at FROM discoveries WHERE reachable = 1 AND (title IS NOT NULL OR length(content_summary) > 0) GROUP BY ALL",
        "pending_analysis_stale": f"{w} SELECT d.ident_hash_hex, d.b32_addr, d.i2p_dns_name, min(coalesce(last_analyzed_at, 0.0)) AS rank, max(d.probed_at) AS probed_at FROM discoveries d LEFT JOIN targets t ON t.ident_hash_hex = d.ident_hash_hex WHERE reachable = 1 AND (last_analyzed_at IS NULL OR last_analyzed_at = 0 OR last_analyzed_at < {NOW} - 2592000) GROUP BY 1, 2, 3",
        "pending_analysis_never": f"{w} SELECT {triple}, 0 AS rank, max(probed_at) AS probed_at FROM discoveries WHERE reachable = 1 AND length(coalesce(deep_analysis, '')) = 0 GROUP BY 1, 2, 3",
        "pending_translation": f"{w} SELECT id, ident_hash_hex, i2p_dns_name, detected_lang, content_summary, title FROM discoveries WHERE {_TRANSLATABLE}",
        "preflight_counts": f"""{b} SELECT 'targets_all' AS layer, count(*) AS n FROM targets UNION ALL SELECT 'targets_reachable', count(*) FROM targets t WHERE {_EVER} UNION ALL SELECT 'targets_never', count(*) FROM targets WHERE last_probed_at <= 0
UNION ALL SELECT 'targets_stale', count(*) FROM targets WHERE last_probed_at < {NOW} - 86400 UNION ALL SELECT 'translate', count(*) FROM discoveries WHERE {_TRANSLATABLE} UNION ALL SELECT 'analyze', count(*) FROM book WHERE reachable = 1 AND interest_score IS NULL
UNION ALL SELECT 'extractor', count(*) FROM book WHERE needs_review = 1 UNION ALL SELECT 'export', count(*) FROM book""",
        "reachability_hourly": series("%Y-%m-%d %H:00"),
        "reachability_daily": series("%Y-%m-%d"),
        "timeline_latest": f"{w} SELECT coalesce(nullif(i2p_dns_name, ''), b32_addr) AS dns_name, reachable, status_code, {_UTC} AS probed_at_utc FROM discoveries d WHERE probed_at = (SELECT max(probed_at) FROM discoveries x WHERE x.ident_hash_hex = d.ident_hash_hex)",
        "content_type_histogram": f"{b} SELECT coalesce(nullif(trim(content_type), ''), 'unknown') AS content_type, count(*) AS n, count(*) FILTER (WHERE reachable = 1) AS reachable FROM book GROUP BY 1",
        "best_probe": f"{best} SELECT ident_hash_hex, id, reachable, body_length, response_time FROM r WHERE rn = 1",
        "via_method_merge": f"{best} SELECT ident_hash_hex, CASE WHEN by_b32 AND by_dns THEN 'b32+dns' WHEN by_b32 THEN 'b32' WHEN by_dns THEN 'dns' ELSE probe_mode END AS merged_via FROM r WHERE rn = 1",
        "dedup_latest": f"{w} SELECT id, ident_hash_hex, probe_mode, status_code FROM raw_probes WHERE id IN (SELECT max(id) FROM raw_probes GROUP BY ident_hash_hex, probe_mode)",
        "upsert_discoveries": f"{w} SELECT {fold} FROM discoveries",
        "upsert_fold": f"{w} SELECT {fold}, deep_analysis FROM discoveries",
        "upsert_targets_ignore": f"""{w}, pairs AS (SELECT DISTINCT ident_hash_hex, CASE WHEN id % 4 = 0 THEN i2p_dns_name ELSE 'new' || i2p_dns_name END AS i2p_dns_name FROM targets WHERE id % 2 = 0)
SELECT ident_hash_hex, i2p_dns_name, source, CASE WHEN source = 'addressbook' AND (ident_hash_hex, i2p_dns_name) IN (SELECT (ident_hash_hex, i2p_dns_name) FROM pairs) THEN {NOW} ELSE last_updated_at END AS last_updated_at FROM targets
UNION ALL SELECT ident_hash_hex, i2p_dns_name, 'addressbook', {NOW} FROM pairs WHERE (ident_hash_hex, i2p_dns_name) NOT IN (SELECT (ident_hash_hex, i2p_dns_name) FROM targets)""",
        "link_seed_antijoin": f"""{w}, f AS (SELECT target_site AS i2p_dns_name, min(source_site) AS source_site FROM links WHERE target_site NOT IN (SELECT i2p_dns_name FROM targets) GROUP BY 1)
SELECT i2p_dns_name, 'linked' AS source, source_site, concat(source_site, ' → ', i2p_dns_name) AS provenance_chain, 1 AS crawl_depth FROM f""",
        "import_generation": f"""{w}, e AS (SELECT DISTINCT ident_hash_hex, CASE WHEN id % 5 = 0 THEN 'imported-' || i2p_dns_name ELSE i2p_dns_name END AS i2p_dns_name FROM targets WHERE id % 3 <> 1)
SELECT t.ident_hash_hex, t.i2p_dns_name, CASE WHEN e.i2p_dns_name IS NOT NULL THEN 'susi_export:router' ELSE source END AS source, CASE WHEN e.i2p_dns_name IS NOT NULL THEN 7 WHEN source LIKE 'susi_export:%' THEN 0 ELSE susi_active END AS susi_active, CASE WHEN e.i2p_dns_name IS NOT NULL THEN 'AAAA' ELSE dest_data END AS dest_data
FROM targets t LEFT JOIN e ON e.ident_hash_hex = t.ident_hash_hex AND e.i2p_dns_name = t.i2p_dns_name
UNION ALL SELECT ident_hash_hex, i2p_dns_name, 'susi_export:router', 7, 'AAAA' FROM e WHERE (ident_hash_hex, i2p_dns_name) NOT IN (SELECT (ident_hash_hex, i2p_dns_name) FROM targets)""",
        "fill_dest_data": f"{w} SELECT id, CASE WHEN length(dest_data) < 20 AND ident_hash_hex <> '' THEN 'filled-blob-for-hash-' || substr(ident_hash_hex, 1, 6) ELSE dest_data END AS dest_data FROM targets",
        "reconcile_stale": f"{w} SELECT id, CASE WHEN source = 'addressbook' AND upper(ident_hash_hex) NOT IN (SELECT ident_hash_hex FROM routers) THEN 'addressbook:stale' ELSE source END AS source, CASE WHEN source = 'addressbook' AND upper(ident_hash_hex) IN (SELECT ident_hash_hex FROM routers) THEN {NOW} ELSE last_updated_at END AS last_updated_at FROM targets",
        "cleanup_ttl": f"{w} SELECT id, ident_hash_hex, reachable FROM discoveries WHERE NOT (reachable = 0 AND probed_at < {NOW} - 36 * 3600)",
        "clear_review": f"{w} SELECT id, CASE WHEN ident_hash_hex = '356A192B7913B04C54574D18C28D46E6395428AB' AND probed_at = (SELECT max(probed_at) FROM discoveries x WHERE x.ident_hash_hex = d.ident_hash_hex) THEN 0 ELSE needs_review END AS needs_review FROM discoveries d",
        "update_analysis": f"{w} SELECT id, CASE WHEN coalesce(deep_analysis, '') = '' THEN 20 ELSE length(deep_analysis) END AS analysis_length FROM discoveries",
        "backoff_exponential": f"{w}{_FAILS} SELECT ident_hash_hex, f AS consecutive_failures, {interval} AS backoff_until, seen AS last_probed_at FROM state",
        "backoff_fixed": f"{w}{_FAILS} SELECT ident_hash_hex, f AS consecutive_failures, CASE WHEN f = 0 THEN 0.0 ELSE seen + 300.0 * f END AS backoff_until, seen AS last_probed_at FROM state",
        "backoff_targets": f"""{w}, p AS (SELECT *, CASE WHEN ident_hash_hex <> '' THEN ident_hash_hex ELSE i2p_dns_name END AS k FROM raw_probes WHERE probed_at > {NOW} - 432000),
m AS (SELECT *, max(CASE WHEN reachable = 1 THEN probed_at END) OVER (PARTITION BY k) AS last_ok FROM p),
s AS (SELECT k, count(*) FILTER (WHERE reachable = 0 AND (last_ok IS NULL OR probed_at > last_ok)) AS nf, max(probed_at) AS seen, max(reachable) AS ok FROM m GROUP BY k),
j AS (SELECT t.*, s.nf, s.seen, CASE WHEN s.ok = 1 THEN s.nf ELSE consecutive_failures + s.nf END AS f FROM targets t LEFT JOIN s ON s.k = CASE WHEN t.ident_hash_hex <> '' THEN t.ident_hash_hex ELSE t.i2p_dns_name END)
SELECT id, cast(coalesce(f, consecutive_failures) AS int) AS consecutive_failures, CASE WHEN nf IS NULL THEN backoff_until WHEN f = 0 THEN 0.0 ELSE seen + [60, 300, 1800, 7200, 43200, 604800][least(f, 6)] END AS backoff_until, coalesce(seen, last_probed_at) AS last_probed_at FROM j""",
        "catalog_full_outer": f"{w} SELECT coalesce(r.ident_hash_hex, l.ident_hash_hex) AS ident_hash_hex, CASE WHEN r.ident_hash_hex IS NULL THEN 0 ELSE 1 END AS routers, CASE WHEN l.ident_hash_hex IS NULL THEN 0 ELSE 1 END AS leasesets, bandwidth_kbps FROM routers r FULL JOIN leasesets l ON r.ident_hash_hex = l.ident_hash_hex",
        "catalog_stats": f"{w} SELECT count(*) AS routers, count(*) FILTER (WHERE contains(caps, 'f')) AS floodfills, coalesce(cast(trunc(avg(bandwidth_kbps) FILTER (WHERE bandwidth_kbps > 0)) AS int), 0) AS avg_kbps, coalesce(max(bandwidth_kbps) FILTER (WHERE bandwidth_kbps > 0), 0) AS max_kbps, (SELECT count(*) FROM leasesets) AS leasesets, (SELECT count(*) FROM (SELECT ident_hash_hex FROM routers UNION SELECT ident_hash_hex FROM leasesets)) AS destinations FROM routers",
        "bw_class": f"{w} SELECT ident_hash_hex, caps, bandwidth_kbps, CASE WHEN bandwidth_kbps < 12 THEN 'vlow' WHEN bandwidth_kbps < 48 THEN 'low' WHEN bandwidth_kbps < 64 THEN 'below_avg' WHEN bandwidth_kbps < 256 THEN 'avg' WHEN bandwidth_kbps < 2048 THEN 'high' ELSE 'extra_high' END AS bw_class FROM routers",
        "caps_bandwidth": f"{w} SELECT ident_hash_hex, CASE caps WHEN 'XfR' THEN 4096 WHEN 'LR' THEN 30 WHEN 'OfR' THEN 192 ELSE 6 END AS kbps FROM routers",
        "content_depth": f"{b} SELECT dns_name, content_depth FROM book",
        "stability_index": f"{b} SELECT dns_name, stability_index FROM book",
        "interest_score": f"{w} SELECT id, CASE WHEN length(coalesce(deep_analysis, '')) > 50 AND json_extract_string(deep_analysis, '$.interest_score') IS NOT NULL THEN coalesce(try_cast(regexp_extract(json_extract_string(deep_analysis, '$.interest_score'), '^\\s*([+-]?\\d+)', 1) AS int), 0) END AS interest_score FROM discoveries",
        "language_fallback": f"{b} SELECT dns_name, {lang} AS detected_lang FROM book",
        "page_title": f"{w} SELECT page_id, {_TITLE} AS title FROM page_bodies",
        "page_plain_text": f"{w} SELECT page_id, {_PLAIN} AS text FROM page_bodies",
        "meta_description": f"{w} SELECT page_id, trim({meta}) AS description FROM page_bodies",
        "bucket_classify": f"{w} SELECT page_id, {_bucket()} AS bucket FROM page_bodies",
        "fallback_classify": falls,
        "tech_stack": f"{w} SELECT page_id, array_to_string(list_filter([{named(tech)}], lambda x: x IS NOT NULL), ',') AS tech, coalesce({named(frames)}, '') AS framework FROM page_bodies",
        "flags_explode": f"{w} {_flag_rows()}",
        "page_headings": heads,
        "paragraph_excerpts": para,
        "link_extract": f"{w} SELECT page_id, array_to_string({_LINKS}, ',') AS links FROM page_bodies",
        "link_graph_bfs": f"""{w.replace("WITH ", "WITH RECURSIVE ", 1)}, e AS (SELECT DISTINCT * FROM links WHERE source_site <> target_site),
l0 AS (SELECT DISTINCT source_site AS site, 0 AS depth, '' AS source_site, source_site AS provenance_chain FROM links WHERE source_site IN ('site1.i2p', 'site2.i2p')),
l1 AS (SELECT target_site AS site, 1 AS depth, min(l0.site) AS source_site, min_by(provenance_chain, l0.site) || ' → ' || target_site AS provenance_chain FROM l0 JOIN e ON e.source_site = l0.site WHERE target_site NOT IN (SELECT site FROM l0) GROUP BY target_site),
a1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
l2 AS (SELECT target_site AS site, 2 AS depth, min(l1.site) AS source_site, min_by(provenance_chain, l1.site) || ' → ' || target_site AS provenance_chain FROM l1 JOIN e ON e.source_site = l1.site WHERE target_site NOT IN (SELECT site FROM a1) GROUP BY target_site),
a2 AS (SELECT * FROM a1 UNION ALL SELECT * FROM l2),
l3 AS (SELECT target_site AS site, 3 AS depth, min(l2.site) AS source_site, min_by(provenance_chain, l2.site) || ' → ' || target_site AS provenance_chain FROM l2 JOIN e ON e.source_site = l2.site WHERE target_site NOT IN (SELECT site FROM a2) GROUP BY target_site)
SELECT * FROM a2 UNION ALL SELECT * FROM l3""",
        "smoke_validation": f"""{w}, c AS (SELECT id, list_filter([CASE WHEN reachable <> 1 THEN 'probe_ok' END, CASE WHEN NOT (status_code >= 100 AND status_code < 500) THEN 'status_in_range' END, CASE WHEN body_length < 128 THEN 'body_sufficient' END,
  CASE WHEN content_type IN ('', 'unknown') THEN 'content_classified' END, CASE WHEN trim(content_summary) = '' THEN 'summary_present' END, CASE WHEN error_msg <> '' THEN 'no_fatal_error' END], lambda x: x IS NOT NULL) AS f FROM discoveries)
SELECT id, len(f) = 0 AS passed, array_to_string(f, ',') AS failed_checks FROM c""",
        "link_seed_chains": f"""{w}, f AS (SELECT target_site AS site, min(source_site) || ' → ' || target_site AS chain FROM links WHERE target_site NOT IN (SELECT i2p_dns_name FROM targets) GROUP BY 1)
SELECT 'next-' || target_site AS i2p_dns_name, target_site AS source_site, coalesce(chain, target_site) || ' → next-' || target_site AS provenance_chain, 2 AS crawl_depth FROM (SELECT DISTINCT target_site FROM links) LEFT JOIN f ON site = target_site""",
        "new_target_count": f"{w} SELECT count(*) AS new_targets FROM targets WHERE source = 'linked' AND last_probed_at <= 0",
        "probe_order": f"{w} SELECT id, ident_hash_hex, reachable, response_time FROM raw_probes ORDER BY reachable DESC, response_time, id",
        "crawl_depth_stats": f"""{w}, s0 AS (SELECT DISTINCT source_site AS site FROM links WHERE source_site IN ('site1.i2p', 'site2.i2p')),
s1 AS (SELECT DISTINCT target_site AS site FROM links WHERE source_site IN (FROM s0) AND target_site NOT IN (FROM s0)),
s2 AS (SELECT DISTINCT target_site AS site FROM links WHERE source_site IN (FROM s1) AND target_site NOT IN (FROM s0) AND target_site NOT IN (FROM s1)),
s AS (SELECT site, 0 AS depth FROM s0 UNION ALL SELECT site, 1 FROM s1 UNION ALL SELECT site, 2 FROM s2)
SELECT depth, count(*) AS attempted, count(*) FILTER (WHERE reachable = 1) AS ok, count(*) FILTER (WHERE reachable = 0) AS failed FROM raw_probes JOIN s ON i2p_dns_name = site GROUP BY depth""",
        "probe_urls": f"""{w} SELECT id, 'http://' || CASE WHEN i2p_dns_name = '' THEN b32_addr ELSE i2p_dns_name END || '/' AS url, CASE WHEN id % 3 = 0 THEN lower(ident_hash_hex) ELSE ' https://' || i2p_dns_name || '/a/b' END AS address,
  CASE WHEN id % 3 = 0 THEN ident_hash_hex ELSE '' END AS ident_hash_hex, CASE WHEN id % 3 = 0 THEN '' ELSE i2p_dns_name END AS i2p_dns_name FROM targets""",
        "decoded_blobs": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN sha256(c_name) END AS decoded, CASE WHEN c_custkey % 3 < 2 THEN upper(substr(sha256(c_name), 1, 40)) END AS identity FROM customer",
        "file_name_hashes": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE sha1(c_name) END AS file_hash,
  upper(CASE WHEN c_custkey % 4 = 0 THEN sha1(translate(to_base64(unhex(sha256(c_name))), '+/', '-~')) ELSE sha1(c_name) END) AS link_hash FROM customer""",
        "readiness": "SELECT c_custkey, round(0.4::DOUBLE * least(1.0::DOUBLE, (c_custkey % 40) / greatest(10.0::DOUBLE, c_custkey % 25)) + 0.4::DOUBLE * least(1.0::DOUBLE, (c_custkey % 5) / 2.0::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, (c_custkey % 700) / 300.0::DOUBLE), 6) AS readiness FROM customer",
        "http_dates": f"""{w}, t AS (SELECT id, make_timestamp(cast(floor(probed_at) AS bigint) * 1000000) AS day FROM raw_probes)
SELECT id, CASE id % 5 WHEN 0 THEN strftime(day, 'about %a, %d %b %Y %H:%M:%S GMT') WHEN 1 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS day FROM t""",
        "flag_summary_lines": f"""{w} SELECT page_id, CASE type WHEN 'robots_txt' THEN 'Access policy: ' WHEN 'contact_signal' THEN 'Contact: ' ELSE 'Forum software: ' END || value AS line FROM ({_flag_rows()}) WHERE type IN ('robots_txt', 'contact_signal', 'forum_software')
UNION ALL SELECT page_id, 'Redirect chain: depth ' || page_id % 4 FROM pages WHERE page_id % 4 > 1""",
        "translation_inputs": f"""{w}, s AS (SELECT id, content_summary AS s, string_split(content_summary, chr(10)) AS l FROM discoveries)
SELECT id, array_to_string(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x NOT LIKE 'http%' AND length(x) >= 10), chr(10)) AS input, length(trim(s)) >= 10 AND s NOT LIKE '%[ORIGINAL:%' AS wanted,
  CASE WHEN id % 2 <> 0 THEN trim(s) WHEN len(l) > 1 THEN trim(l[1]) ELSE trim(s || chr(10) || 'more' || chr(10) || 'lines') END AS answer FROM s""",
        "header_names": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Content-Type,Server' ELSE 'Content-Type,X-Powered-By' END AS names, CASE WHEN page_id % 2 = 0 THEN concat('made by ', page_id) ELSE '' END AS server,
  CASE WHEN page_id % 2 = 0 THEN '' ELSE concat('made by ', page_id) END AS powered_by FROM pages""",
        "sample_ids": f"{w} SELECT page_id, substr(sha256(substr(html, 1, 8192)), 1, 12) AS sample_id FROM page_bodies",
        "hosts_scan": _hosts(),
        "page_fingerprints": _fingerprints(),
        "mark_contrast": r"""WITH d AS (SELECT doc_id, quality = 0 AS flagged, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
m AS (SELECT doc_id, flagged, unnest(list_distinct(list_filter(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), lambda x: length(x) BETWEEN 4 AND 60))) AS mark FROM d)
SELECT mark, count(*) FILTER (WHERE flagged) AS n_flagged, count(*) FILTER (WHERE NOT flagged) AS n_claimed, 1.0::DOUBLE AS precision FROM m GROUP BY mark HAVING count(*) FILTER (WHERE flagged) >= 3 AND count(*) FILTER (WHERE NOT flagged) = 0""",
        "smoke_exit_code": f"{w} SELECT CASE WHEN bool_or(reachable = 0) THEN 1 WHEN bool_or(content_type = '') THEN 2 ELSE 0 END AS exit_code FROM discoveries",
        "hosts_export_lines": f"""{b}, blobs AS (SELECT i2p_dns_name AS dns_name, {blob} AS blob FROM targets GROUP BY 1)
SELECT dns_name, n AS line_no, CASE n WHEN 0 THEN '#' || dns_name || CASE WHEN coalesce(b32_addr, '') <> '' THEN ': ' || b32_addr ELSE '' END ELSE dns_name || '=' || coalesce(blob, '') END AS line FROM book LEFT JOIN blobs USING (dns_name), (VALUES (0), (1)) v(n)""",
        "export_entries": f"{b} SELECT dns_name, title, reachable = 1 AS reachable, response_time_sec, body_length, {lang} AS detected_lang, content_depth FROM book",
        "b32_address": f"{w} SELECT id, concat({_base32()}, '.b32.i2p') AS address FROM discoveries",
        "robots_block": f"""{w}, p AS (SELECT page_id, page_id % 3 AS m, ['/', '/private/x', '/private/open/1', '/a/b.pdf', '/f.zip'][page_id % 5 + 1] AS path FROM page_bodies)
SELECT page_id, path, CASE m WHEN 1 THEN 3 ELSE 2 END AS n_rules, CASE WHEN m = 0 THEN true WHEN starts_with(path, '/private') AND NOT (m = 1 AND starts_with(path, '/private/open')) THEN true
  WHEN m = 1 AND path LIKE '/%.pdf' THEN true WHEN m = 2 AND ends_with(path, '.zip') THEN true ELSE false END AS blocked, m = 0 AS fully_blocked FROM p""",
        "detect_language": _language(),
        "content_hash": f"{w} SELECT page_id, CASE WHEN length(html) > 0 THEN sha256(html) ELSE '' END AS content_hash FROM page_bodies",
        "lang_tag_summary": f"""{w}, s AS (SELECT id, detected_lang, list_filter(list_transform(string_split(content_summary, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM discoveries WHERE {_TRANSLATABLE}),
t AS (SELECT *, list_position(list_transform(l, lambda x: NOT starts_with(x, 'http') AND length(x) >= 10), true) AS k, concat('[detected_language: ', detected_lang, CASE detected_lang WHEN 'de' THEN ' (German)' WHEN 'fr' THEN ' (French)' ELSE '' END, ']') AS tag FROM s)
SELECT id, CASE WHEN len(l) = 0 THEN '' WHEN k IS NULL OR k = 0 THEN array_to_string(list_concat([tag], l), chr(10))
  ELSE array_to_string(list_concat([tag, concat('TRANSLATED [original: ', l[k], ']')], list_concat(l[1:k - 1], l[k + 1:])), chr(10)) END AS summary FROM t""",
        "stripped_text": f"""{w}, a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?(</script\\s*>|\\z)', ' ', 'g'), '(?is)<style\\b.*?(</style\\s*>|\\z)', ' ', 'g'), '(?is)<noscript\\b.*?(</noscript\\s*>|\\z)', ' ', 'g') AS h FROM page_bodies),
u AS (SELECT page_id, regexp_replace(h, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g') AS h FROM a)
SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 8192) AS text FROM u""",
        "host_fill_forward": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations",
        "report_lines": f"""{b} SELECT '1 totals' AS section, '' AS name, concat('- ', count(*), ' destinations, ', count(*) FILTER (WHERE reachable = 1), ' reachable, ', count(*) FILTER (WHERE reachable <> 1), ' unreachable') AS line FROM book
UNION ALL SELECT '2 types', coalesce(nullif(content_type, ''), 'unknown'), concat('| ', coalesce(nullif(content_type, ''), 'unknown'), ' | ', count(*), ' |') FROM book GROUP BY 2
UNION ALL SELECT '3 reachable', dns_name, concat('### ', dns_name, ' (', json_array_length(found_links), ' links, modified )') FROM book WHERE reachable = 1
UNION ALL SELECT '4 unreachable', dns_name, concat('- ', dns_name) FROM book WHERE reachable = 0""",
    }
