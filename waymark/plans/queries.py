"""The registered queries of the engine, over derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags as flag_functions
from ..functions import language, ngrams, pages, robots, scalars
from ..operators import backoff, crawl, export, extractors, merge, relational, review
from ..sources import hosts
from .address_book import address_book
from .derived import NOW, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(*tables: str, name: str | None = None):
    """Registers a function of derived tables as a query."""

    def add(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(*load(spark, sf_dir, *tables))
        return f

    return add


def _book(d, r, ls):
    return address_book(d, r, ls)


BOOK = ("discoveries", "routers", "leasesets")


@query(*BOOK, name="address_book")
def book(d, r, ls):
    return _book(d, r, ls)


@query(*BOOK)
def address_book_limit(d, r, ls):
    return _book(d, r, ls).select("dns_name", "reachable", "content_depth", "stability_index").orderBy("dns_name").limit(25)


@query("raw_probes")
def latest_probes_by_hash(p):
    return relational.by_hash(p, "356a192b7913b04c54574d18c28d46e6395428ab").select("id", "probe_mode", "status_code", "probed_at_utc")


@query("raw_probes")
def latest_probes_by_dns(p):
    return relational.by_name(p, "site2.i2p").select("id", "probe_mode", "status_code", "probed_at_utc")


@query(*BOOK)
def summary_stats(d, r, ls):
    return relational.summary(d, r, ls)


@query("raw_probes")
def duplicate_rows(p):
    return relational.duplicate_count(p)


@query(*BOOK)
def flagged(d, r, ls):
    return relational.flagged(_book(d, r, ls), hints=True).drop("content_summary", "b32_addr")


for _mode, _name in (("all", "targets_all"), ("reachable_only", "targets_reachable"), ("never_probed", "targets_never"), ("stale", "targets_stale")):
    query("targets", "discoveries", name=_name)(lambda t, d, mode=_mode: relational.target_queue(t, d, mode, NOW, skip_backoff=False))


@query("targets", "discoveries")
def targets_skip_backoff(t, d):
    return relational.target_queue(t, d, "all", NOW)


@query("targets")
def crawl_candidates(t):
    return relational.crawl_candidates(t, 2, 20).select("id", "i2p_dns_name", "source_site", "crawl_depth")


@query("targets")
def crawl_candidates_all(t):
    return relational.crawl_candidates(t, 2).select("id", "i2p_dns_name", "source_site", "crawl_depth")


for _mode in ("reachable", "stale", "never_analyzed"):
    query("discoveries", "targets", name=f"pending_analysis_{_mode.removesuffix('_analyzed')}")(lambda d, t, mode=_mode: relational.pending_analyses(d, t, mode, NOW))


@query("discoveries")
def pending_translation(d):
    return relational.pending_translations(d)


@query("targets", *BOOK)
def preflight_counts(t, d, r, ls):
    return relational.preflight(t, d, _book(d, r, ls), NOW)


@query("raw_probes")
def reachability_hourly(p):
    return relational.reachability_series(p)


@query("raw_probes")
def reachability_daily(p):
    return relational.reachability_series(p, "day")


@query("discoveries")
def timeline_latest(d):
    return relational.timeline(d)


@query(*BOOK)
def content_type_histogram(d, r, ls):
    return relational.type_histogram(_book(d, r, ls))


@query("raw_probes")
def best_probe(p):
    return relational.best_probe(p).select("ident_hash_hex", "id", "reachable", "body_length", "response_time")


@query("raw_probes")
def via_method_merge(p):
    return relational.best_probe(p).select("ident_hash_hex", "merged_via")


@query("raw_probes")
def dedup_latest(p):
    return merge.keep_last_id(p).select("id", "ident_hash_hex", "probe_mode", "status_code")


@query("raw_probes")
def upsert_discoveries(p):
    """Stored probes of the first twenty days, with the later ones merged in."""
    bare = p.drop("deep_analysis")
    early = F.col("probed_at") < NOW - 11 * 86400
    return merge.upsert_discoveries(merge.fold_probes(bare.where(early)), bare.where(~early)).drop("flags", "last_modified")


@query("raw_probes")
def upsert_fold(p):
    return merge.fold_probes(p).drop("flags", "last_modified")


@query("targets")
def upsert_targets_ignore(t):
    pairs = t.where("id % 2 = 0").select("ident_hash_hex", F.when(F.col("id") % 4 == 0, F.col("i2p_dns_name")).otherwise(F.concat(F.lit("new"), "i2p_dns_name")).alias("i2p_dns_name"))
    return merge.insert_targets(t, pairs, "addressbook", NOW).select("ident_hash_hex", "i2p_dns_name", "source", "last_updated_at")


@query("targets", "links")
def link_seed_antijoin(t, links):
    return merge.seed_links(t, links.select(F.col("target_site").alias("i2p_dns_name"), "source_site"), 1).select("i2p_dns_name", "source", "source_site", "provenance_chain", "crawl_depth")


@query("targets", "links")
def link_seed_chains(t, links):
    """Sites that are linked from sites which were themselves found by links: the chain grows by one."""
    once = merge.seed_links(t, links.select(F.col("target_site").alias("i2p_dns_name"), "source_site"), 1)
    beyond = links.select(F.concat(F.lit("next-"), "target_site").alias("i2p_dns_name"), F.col("target_site").alias("source_site"))
    return merge.seed_links(once, beyond, 2).where("crawl_depth = 2 and i2p_dns_name like 'next-%'").select("i2p_dns_name", "source_site", "provenance_chain", "crawl_depth")


@query("targets")
def new_target_count(t):
    return relational.new_target_count(t)


@query("raw_probes")
def probe_order(p):
    return relational.probe_order(p).select("id", "ident_hash_hex", "reachable", "response_time")


@query("raw_probes", "links")
def crawl_depth_stats(p, links):
    """Probes of the sites that a crawl of two steps reaches, by the step."""
    seeds = links.where("source_site in ('site1.i2p', 'site2.i2p')").select(F.col("source_site").alias("site")).distinct()
    return crawl.depth_stats(p.join(crawl.crawl(seeds, links, 2), F.col("i2p_dns_name") == F.col("site")))


@query("targets")
def probe_urls(t):
    """Where targets are probed, and the hash or name that their address is read as."""
    x = t.select("id", relational.probe_url(F.col("i2p_dns_name"), F.col("b32_addr")).alias("url"), F.when(F.col("id") % 3 == 0, F.lower("ident_hash_hex")).otherwise(F.concat(F.lit(" https://"), "i2p_dns_name", F.lit("/a/b"))).alias("address"))
    return relational.normalise_addresses(x)


@query("targets")
def import_generation(t):
    entries = t.where("id % 3 <> 1").select("ident_hash_hex", F.when(F.col("id") % 5 == 0, F.concat(F.lit("imported-"), "i2p_dns_name")).otherwise(F.col("i2p_dns_name")).alias("i2p_dns_name"), F.lit("AAAA").alias("dest_b64"))
    return merge.import_entries(t, entries, "router", 7, NOW).select("ident_hash_hex", "i2p_dns_name", "source", "susi_active", "dest_data")


@query("targets")
def fill_dest_data(t):
    blobs = t.where("ident_hash_hex <> ''").select("ident_hash_hex", F.concat(F.lit("filled-blob-for-hash-"), F.substring("ident_hash_hex", 1, 6)).alias("dest_b64"))
    return merge.fill_dest_data(t, blobs).select("id", "dest_data")


@query("targets", "routers")
def reconcile_stale(t, r):
    return merge.reconcile(t, r, NOW)[0].select("id", "source", "last_updated_at")


@query("discoveries")
def cleanup_ttl(d):
    return merge.cleanup(d, NOW, 36).select("id", "ident_hash_hex", "reachable")


@query("discoveries")
def clear_review(d):
    return merge.clear_review(d, "356A192B7913B04C54574D18C28D46E6395428AB").select("id", "needs_review")


@query("discoveries", "targets")
def update_analysis(d, t):
    new = d.select("ident_hash_hex", F.lit('{"site_type": "new"}').alias("analysis")).distinct()
    return merge.update_analysis(d, t, new, NOW)[0].select("id", F.length("deep_analysis").alias("analysis_length"))


@query("raw_probes")
def backoff_exponential(p):
    return backoff.backoff_state(p)


@query("raw_probes")
def backoff_fixed(p):
    return backoff.backoff_state(p, "fixed")


@query("targets", "raw_probes")
def backoff_targets(t, p):
    return backoff.apply_backoff(t, p.where(F.col("probed_at") > NOW - 5 * 86400)).select("id", "consecutive_failures", "backoff_until", "last_probed_at")


@query("routers", "leasesets")
def catalog_full_outer(r, ls):
    return relational.destinations(r, ls)


@query("routers", "leasesets")
def catalog_stats(r, ls):
    return relational.catalog_stats(r, ls)


@query("routers")
def bw_class(r):
    return relational.fastest_routers(r)


@query("routers")
def caps_bandwidth(r):
    return r.select("ident_hash_hex", scalars.caps_bandwidth(F.col("caps")).alias("kbps"))


@query(*BOOK)
def content_depth(d, r, ls):
    return _book(d, r, ls).select("dns_name", "content_depth")


@query(*BOOK)
def stability_index(d, r, ls):
    return _book(d, r, ls).select("dns_name", "stability_index")


@query("discoveries")
def interest_score(d):
    return d.select("id", scalars.interest_score(F.col("deep_analysis")).alias("interest_score"))


@query(*BOOK)
def language_fallback(d, r, ls):
    return relational.language_fallback(_book(d, r, ls), d).select("dns_name", "detected_lang")


@query("page_bodies")
def page_title(p):
    return p.select("page_id", pages.title(F.col("html")).alias("title"))


@query("page_bodies")
def page_plain_text(p):
    return p.select("page_id", pages.plain_text(F.col("html")).alias("text"))


@query("page_bodies")
def meta_description(p):
    return p.select("page_id", pages.meta_description(F.col("html")).alias("description"))


@query("page_bodies")
def bucket_classify(p):
    return p.select("page_id", pages.bucket(pages.title(F.col("html")), F.col("html")).alias("bucket"))


@query("page_bodies")
def fallback_classify(p):
    return p.select("page_id", pages.fallback(F.col("html")).alias("kind"))


@query("page_bodies")
def tech_stack(p):
    return p.select("page_id", F.array_join(pages.tech_stack(F.col("html")), ",").alias("tech"), pages.framework(F.col("html")).alias("framework"))


@query("page_bodies")
def flags_explode(p):
    found = flag_functions.flags(F.col("html"), F.create_map(F.lit("Server"), F.lit("nginx"), F.lit("cf-ray"), F.lit("1")), F.lit(0))
    return p.select("page_id", F.explode(found).alias("f")).select("page_id", "f.type", "f.value")


@query("page_bodies")
def page_headings(p):
    return p.select("page_id", F.array_join(pages.headings(F.col("html")), "|").alias("headings"))


@query("page_bodies")
def paragraph_excerpts(p):
    return p.select("page_id", F.array_join(pages.excerpts(F.col("html"), pages.title(F.col("html"))), "|").alias("excerpts"))


@query("page_bodies")
def page_summary(p):
    x = p.withColumn("title", pages.title(F.col("html"))).withColumn("kind", pages.content_type(F.col("title"), F.col("html")))
    lines = pages.summary_lines(F.col("title"), F.col("html"), F.col("kind"))
    return x.withColumn("lines", lines).select("page_id", "kind", F.array_join("lines", "\n").alias("summary"), pages.review_reason(F.lit(True), F.col("lines"), F.col("html")).alias("review_reason"))


@query("page_bodies")
def link_extract(p):
    return p.select("page_id", F.array_join(pages.links(F.col("html")), ",").alias("links"))


@query("links")
def link_graph_bfs(links):
    seeds = links.where("source_site in ('site1.i2p', 'site2.i2p')").select(F.col("source_site").alias("site")).distinct()
    return crawl.crawl(seeds, links, 3).select("site", "depth", "source_site", "provenance_chain")


@query("page_bodies")
def robots_block(p):
    text = F.concat(F.lit("User-agent: *\nDisallow: /private # all\n"), F.when(F.col("page_id") % 3 == 0, "Disallow: /\n").when(F.col("page_id") % 3 == 1, "Allow: /private/open\nDisallow: /*.pdf\n").otherwise("Disallow: .zip$\n"))
    x = p.select("page_id", robots.rules(text).alias("policy"), F.element_at(F.array(*map(F.lit, ("/", "/private/x", "/private/open/1", "/a/b.pdf", "/f.zip"))), (F.col("page_id") % 5 + 1).cast("int")).alias("path"))
    return x.select("page_id", "path", F.size("policy").alias("n_rules"), robots.blocks(F.col("policy"), F.col("path")).alias("blocked"), robots.fully_blocked(F.col("policy")).alias("fully_blocked"))


@query("discoveries")
def smoke_validation(d):
    results = d.select("id", (F.col("reachable") == 1).alias("probe_ok"), "status_code", "body_length", "content_type", F.col("content_summary").alias("summary"), F.col("error_msg").alias("stage_error"))
    return relational.validate(results).select("id", "passed", F.array_join("failed_checks", ",").alias("failed_checks"))


@query("discoveries")
def smoke_exit_code(d):
    return relational.exit_code(d.select(F.lit(False).alias("store_failed"), (F.col("reachable") == 0).alias("probe_failed"), (F.col("content_type") == "").alias("extract_failed")))


@query("targets", *BOOK)
def hosts_export_lines(t, d, r, ls):
    return export.hosts_lines(_book(d, r, ls), t)


@query(*BOOK)
def export_entries(d, r, ls):
    return export.entries(relational.language_fallback(_book(d, r, ls), d)).select("dns_name", "title", "reachable", "response_time_sec", "body_length", "detected_lang", "content_depth")


@query("discoveries")
def b32_address(d):
    return d.select("id", scalars.b32_address(F.col("ident_hash_hex")).alias("address"))


@query("customer")
def decoded_blobs(c):
    """Destinations in the network's base64, some without padding and some broken, decoded; and their identity hash."""
    blob = F.translate(F.base64(F.unhex(F.sha2(F.col("c_name").cast("binary"), 256))), "+/", "-~")
    blob = F.when(F.col("c_custkey") % 3 == 0, F.regexp_replace(blob, "=", "")).when(F.col("c_custkey") % 3 == 1, blob).otherwise(F.concat(blob, F.lit("!")))
    binary = scalars.decode_blob(blob)
    return c.select("c_custkey", F.lower(F.hex(binary)).alias("decoded"), scalars.identity_hash(binary).alias("identity"))


@query("customer")
def file_name_hashes(c):
    """The hashes that names of record files spell, in either alphabet, and those of links to them."""
    name = F.base64(F.when(F.col("c_custkey") % 4 == 0, F.unhex(F.sha2(F.col("c_name").cast("binary"), 256))).otherwise(F.unhex(F.sha1(F.col("c_name").cast("binary")))))
    name = F.when(F.col("c_custkey") % 2 == 0, F.translate(name, "+/", "-~")).otherwise(F.translate(name, "/", "_"))
    path = F.concat(F.lit("netDb/r1/"), F.when(F.col("c_custkey") % 3 == 0, "leaseSet-").otherwise("routerInfo-"), name, F.lit(".dat"))
    return c.select("c_custkey", scalars.hash_of_file_name(path).alias("file_hash"), scalars.hash_of_link(name).alias("link_hash"))


@query("customer")
def readiness(c):
    """The readiness of a router with the peers, tunnels and uptime that a customer's key stands for."""
    k = F.col("c_custkey")
    return c.select("c_custkey", F.round(scalars.readiness(k % 40, k % 25, k % 5, k % 700), 6).alias("readiness"))


@query("raw_probes")
def http_dates(p):
    """The day of a Last-Modified header; what is no such date stays."""
    text = F.date_format(F.timestamp_seconds(F.floor("probed_at")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return p.select("id", scalars.http_date(F.when(F.col("id") % 5 == 0, F.concat(F.lit("about "), text)).when(F.col("id") % 5 == 1, "").otherwise(text)).alias("day"))


@query("page_bodies")
def flag_summary_lines(p):
    found = flag_functions.flags(F.col("html"), F.create_map(F.lit("Server"), F.lit("nginx")), (F.col("page_id") % 4).cast("int"))
    return p.select("page_id", F.explode(flag_functions.flag_lines(found)).alias("line"))


@query("discoveries")
def translation_inputs(d):
    """What a translator gets of each summary, whether it gets it, and what is taken from its answer."""
    s = F.col("content_summary")
    answer = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), s, F.lit("\nmore\nlines "))).otherwise(s)
    return d.select("id", language.translation_input(s).alias("input"), language.needs_translation(F.replace(s, F.lit("[ORIGINAL:"), F.lit("[original:"))).alias("wanted"), language.clean_answer(answer).alias("answer"))


@query("pages")
def header_names(p):
    """Headers under names of any case, and the server that they name."""
    headers = F.create_map(F.when(F.col("page_id") % 2 == 0, "SERVER").otherwise("x-POWERED-by"), F.concat(F.lit("made by "), F.col("page_id").cast("string")), F.lit("content-type"), F.lit("text/html"))
    normal = scalars.normal_headers(headers)
    return p.select("page_id", F.array_join(F.array_sort(F.map_keys(normal)), ",").alias("names"), scalars.header(headers, "Server").alias("server"), scalars.header(normal, "X-Powered-By").alias("powered_by"))


@query("page_bodies")
def sample_ids(p):
    return p.select("page_id", scalars.sample_id(F.col("html")).alias("sample_id"))


@query("page_bodies")
def content_hash(p):
    return p.select("page_id", scalars.content_hash(F.col("html")).alias("content_hash"))


@query("discoveries")
def lang_tag_summary(d):
    return relational.pending_translations(d).select("id", language.translated_summary(F.col("content_summary"), F.lit("TRANSLATED"), F.col("detected_lang")).alias("summary"))


@query("documents")
def detect_language(d):
    """The language of every document, by a model of the labelled ones whose MD5 of the id starts below 8."""
    model = ngrams.fit(d.where(F.md5(F.col("doc_id").cast("string")) < "8"))
    found = d.select("doc_id", language.detect(F.lit(""), F.col("text"), model).alias("f"))
    return found.select("doc_id", "f.lang", "f.confidence")


@query("conversations")
def host_fill_forward(c):
    """The header that holds at each turn: user turns are headers, others carry them on."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w).alias("header"))


@query("hosts_files")
def hosts_scan(files):
    """The entries of hosts texts, a text a nation: names and addresses of headers hold for the lines below them."""
    return hosts.parse_hosts(files).select("path", F.col("pos").cast("long").alias("pos"), "i2p_dns_name", "ident_hash_hex", "b32_raw", F.col("dest_data_len").cast("long").alias("dest_data_len"), "dest_b64")


@query("headed_pages")
def page_fingerprints(p):
    """What an inspection of each page finds: frameworks with their marks, meta tags, form, structure, type."""
    body = F.col("html")
    named = F.transform(extractors.frameworks(body), lambda f: F.concat(f["name"], F.lit(": "), F.array_join(f["marks"], ", ")))
    tags = F.transform(extractors.meta_tags(body), lambda m: F.concat(m["name"], F.lit("="), m["value"]))
    return p.select("page_id", F.array_join(named, "; ").alias("frameworks"), F.array_join(tags, "|").alias("meta_tags"), extractors.page_form(body).alias("form"), F.array_join(extractors.structure(body), ",").alias("structure"), extractors.detected_type(body, F.lit("")).alias("detected_type"))


@query("documents", "labels")
def mark_contrast(d, q):
    """Marks of documents of bad quality that no document of good quality has."""
    rows = d.join(q.where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("flagged")), "doc_id")
    return review.contrast(rows.select("doc_id", F.col("text").alias("body"), "flagged")).select("mark", "n_flagged", "n_claimed", "precision")


@query("documents", "labels")
def mined_rules(d, q):
    """The rules that cover most documents of bad quality, each with its support and precision."""
    rows = d.join(q.where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("flagged")), "doc_id")
    return review.mine_rules(rows.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "flagged"))


@query("page_bodies")
def stripped_text(p):
    return p.select("page_id", pages.strip_html(F.col("html")).alias("text"))


@query(*BOOK)
def report_lines(d, r, ls):
    return export.report_lines(_book(d, r, ls))
