"""Exports: hosts files, entries for a browsing page, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import http_date, links_of


def hosts_lines(book: DataFrame, targets: DataFrame) -> DataFrame:
    """(dns_name, line_no, line): a comment and a `name=blob` line for each destination, in order of lower-cased names.

    line_no counts within a destination; a global count would gather all rows in one task.
    """
    blobs = targets.where("length(dest_data) > 0 and i2p_dns_name <> ''").groupBy(F.col("i2p_dns_name").alias("dns_name")).agg(F.max_by("dest_data", "id").alias("blob"))
    rows = book.select("dns_name", F.coalesce("b32_addr", F.lit("")).alias("b32")).join(blobs, "dns_name", "left")
    note = F.concat(F.lit("#"), "dns_name", F.when(F.col("b32") != "", F.concat(F.lit(": "), "b32")).otherwise(""))
    value = F.concat("dns_name", F.lit("="), F.coalesce("blob", F.lit("")))
    return rows.select("dns_name", F.posexplode(F.array(note, value)).alias("line_no", "line")).orderBy(F.lower("dns_name"), "dns_name", "line_no")


def write_hosts(book: DataFrame, targets: DataFrame, path: str, exported: str) -> None:
    """A hosts file as text part files in order, with its header."""
    total = book.count()
    head = [f"# Address book: site catalog (auto-generated by discovery probes)", f"# Exported: {exported}", f"# {total} entries"]
    lines = hosts_lines(book, targets)
    first = lines.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "i int, line string").orderBy("i").coalesce(1).select("line")
    first.union(lines.select("line")).write.mode("overwrite").text(path)


def entries(book: DataFrame) -> DataFrame:
    """Rows for a browsing page, without nulls, and their JSON."""
    text = {c: F.coalesce(F.replace(F.col(c), F.lit("\n"), F.lit(" ")), F.lit("")).alias(c) for c in ("dns_name", "b32_addr", "title", "content_type", "content_summary", "deep_site_type", "deep_purpose", "deep_analyzed_at", "last_probed_utc", "detected_lang", "interest_reasons")}
    cols = [*text.values(), F.coalesce("deep_analysis", F.lit("")).alias("deep_analysis_json"), (F.coalesce("reachable", F.lit(0)) == 1).alias("reachable"), F.coalesce("response_time_sec", F.lit(0.0)).alias("response_time_sec"), F.coalesce("body_length", F.lit(0)).cast("long").alias("body_length")]
    cols += ["bandwidth_kbps", F.coalesce("found_links", F.lit("[]")).alias("found_links"), F.coalesce("flags", F.lit("[]")).alias("flags"), "interest_score", F.coalesce("content_depth", F.lit(0.0)).alias("content_depth"), F.coalesce("stability_index", F.lit(0.0)).alias("stability_index")]
    return book.select(*cols)


PAGE = "<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><script>const entries={entries},timeline={timeline},series={series};</script><pre id=o></pre><script>o.textContent=entries.map(e=>(e.reachable?'up   ':'down ')+e.dns_name+'  '+e.content_summary).join('\\n')</script>"


def browse_page(book: DataFrame, timeline: DataFrame, series: DataFrame, title: str = "Site catalog") -> str:
    """One HTML page with the data in it. Meant for books of a size that a browser can show."""
    load = lambda df: "[" + ",".join(r.value for r in df.select(F.to_json(F.struct("*")).alias("value")).toLocalIterator()).replace("</", "<\\/") + "]"
    return PAGE.format(title=title, entries=load(entries(book)), timeline=load(timeline), series=load(series))


def index_page(title: str = "Site catalog", files: tuple[str, ...] = ("browse.html", "hosts.txt")) -> str:
    links = "".join(f'<li><a href="{f}">{f}</a></li>' for f in files)
    return f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><ul>{links}</ul>"


def report_lines(book: DataFrame) -> DataFrame:
    """(section, name, line) of a markdown report: totals, types, sites up, sites down."""
    one = book.agg(F.count("*").alias("n"), F.count_if(F.col("reachable") == 1).alias("up"))
    totals = one.select(F.lit("1 totals").alias("section"), F.lit("").alias("name"), F.concat(F.lit("- "), "n", F.lit(" destinations, "), "up", F.lit(" reachable, "), F.col("n") - F.col("up"), F.lit(" unreachable")).alias("line"))
    kind = F.coalesce(F.nullif("content_type", F.lit("")), F.lit("unknown"))
    types = book.groupBy(kind.alias("name")).agg(F.count("*").alias("n")).select(F.lit("2 types").alias("section"), "name", F.concat(F.lit("| "), "name", F.lit(" | "), "n", F.lit(" |")).alias("line"))
    up = book.where("reachable = 1").select(F.lit("3 reachable").alias("section"), F.col("dns_name").alias("name"), F.concat(F.lit("### "), "dns_name", F.lit(" ("), F.size(links_of(F.col("found_links"))), F.lit(" links, modified "), http_date(F.coalesce("last_modified", F.lit(""))), F.lit(")")).alias("line"))
    down = book.where("reachable = 0").select(F.lit("4 unreachable").alias("section"), F.col("dns_name").alias("name"), F.concat(F.lit("- "), "dns_name").alias("line"))
    return totals.unionAll(types).unionAll(up).unionAll(down)


def report(book: DataFrame) -> str:
    """The report as one text."""
    heads = {"1 totals": "# Catalog report", "2 types": "\n## Types\n| type | n |\n|-|-|", "3 reachable": "\n## Reachable", "4 unreachable": "\n## Unreachable"}
    out, last = [], None
    for r in report_lines(book).orderBy("section", "name").toLocalIterator():
        if r.section != last:
            out.append(heads[r.section])
            last = r.section
        out.append(r.line)
    return "\n".join(out) + "\n"


def book_json(book: DataFrame, limit: int | None = None) -> str:
    rows = book.orderBy("dns_name") if limit is None else book.orderBy("dns_name").limit(limit)
    return json.dumps([json.loads(r.value) for r in rows.select(F.to_json(F.struct("*")).alias("value")).toLocalIterator()])


