"""python -m waymark.cli: sweep, reprobe, analyze, translate, show, query, pending, import, export, report, cleanup, migrate, ready, smoke over a store."""

from __future__ import annotations

import argparse
import datetime
import sys
import time
import uuid

from pyspark.sql import functions as F

from .config import TunnelConfig
from .functions import language
from .operators import enrich, export, merge, relational, review
from .operators import smoke as smoke_runs
from .operators.probe import sweep
from .operators.store import Store
from .plans.address_book import address_book
from .session import cut, session
from .sources import console, fetch, hosts, records, tunnels

MODES = ("all", "reachable_only", "never_probed", "stale")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--store", required=True)
    p.add_argument("--master")
    p.add_argument("--now", type=float)
    sub = p.add_subparsers(dest="action", required=True)
    x = sub.add_parser("sweep", help="probe the target queue")
    x.add_argument("--mode", choices=MODES, default="all")
    x.add_argument("--count", type=int)
    x.add_argument("--crawl-depth", type=int, default=0)
    x.add_argument("--delay", type=float, default=5.0)
    _ways(x)
    x.add_argument("--dry-run", action="store_true")
    x = sub.add_parser("reprobe", help="probe flagged destinations again and clear what is understood now")
    x.add_argument("--limit", type=int)
    x.add_argument("--delay", type=float, default=5.0)
    x.add_argument("--learn", type=int, default=0, metavar="ROUNDS", help="mine rules from flagged pages, and go on until nothing is cleared")
    _ways(x)
    for name, what in (("analyze", "analyse destinations by a language model"), ("translate", "translate summaries by a language model")):
        x = sub.add_parser(name, help=what)
        x.add_argument("--limit", type=int)
        x.add_argument("--model", required=True)
        x.add_argument("--model-url", default="http://127.0.0.1:11434/api/generate")
        if name == "analyze":
            x.add_argument("--mode", choices=("reachable", "stale", "never_analyzed"), default="never_analyzed")
            _ways(x)
    x = sub.add_parser("show", help="the address book")
    x.add_argument("--limit", type=int)
    x.add_argument("--needs-review", action="store_true")
    x.add_argument("--json", action="store_true")
    x = sub.add_parser("query", help="latest probes of a hash or a name, or the summary")
    x.add_argument("--hash")
    x.add_argument("--dns")
    x = sub.add_parser("pending", help="what to analyse or translate")
    x.add_argument("what", choices=("reachable", "stale", "never_analyzed", "translate"))
    x.add_argument("--limit", type=int)
    x = sub.add_parser("import", help="targets of a hosts export, or routers and lease sets of a folder")
    x.add_argument("kind", choices=("hosts", "netdb"))
    x.add_argument("path")
    x.add_argument("--book", default="router")
    x.add_argument("--console", help="where to look for routers if the folder holds no records")
    x = sub.add_parser("export", help="hosts file and pages")
    x.add_argument("path")
    x.add_argument("--site", help="also write pages to this local folder")
    sub.add_parser("report", help="markdown report")
    x = sub.add_parser("cleanup", help="remove old unreachable rows")
    x.add_argument("--max-age-hours", type=float, default=168)
    sub.add_parser("migrate", help="bring tables of an older layout into the present one")
    x = sub.add_parser("ready", help="wait until a router is ready")
    x.add_argument("console")
    x.add_argument("--wait", type=float, default=600.0)
    x.add_argument("--poll", type=float, default=30.0)
    x = sub.add_parser("smoke", help="probe, validate and store the targets of a JSON file; the exit code says what failed")
    x.add_argument("targets")
    x.add_argument("--delay", type=float, default=2.0)
    x.add_argument("--dry-run", action="store_true")
    x.add_argument("--json", action="store_true")
    _ways(x)
    return p


def _ways(x: argparse.ArgumentParser) -> None:
    """Options of a way to fetch."""
    x.add_argument("--via", choices=("socks", "sam", "http-proxy"), default="http-proxy")
    x.add_argument("--timeout", type=float, default=120.0)
    for way, port in (("proxy", 4444), ("socks", 4447), ("sam", 9025)):
        x.add_argument(f"--{way}", default=f"127.0.0.1:{port}", metavar="HOST:PORT")


def _fetcher(a: argparse.Namespace) -> fetch.Fetcher:
    ends = {way: getattr(a, way).removeprefix("http://").rstrip("/").rpartition(":") for way in ("proxy", "socks", "sam")}
    c = TunnelConfig.of({f"{way}_{k}": v for way, (host, _, port) in ends.items() for k, v in (("host", host), ("port", port))})
    return fetch.Retrying(tunnels.fetcher(a.via, c, a.timeout))


def print_all(rows) -> None:
    """Prints every row, a partition at a time."""
    print(*rows.columns, sep="\t")
    for r in rows.toLocalIterator():
        print(*("NULL" if x is None else str(x).replace("\t", "\\t").replace("\n", "\\n") for x in r), sep="\t")


def smoke(store: Store, a: argparse.Namespace, now: float) -> int:
    t = fetch.load_targets(store.spark, a.targets)
    if not t.limit(1).count():
        return 4
    counts = smoke_runs.run(store, t, _fetcher(a), now, a.delay, a.dry_run)
    if a.json:
        print(smoke_runs.report(store, now, counts))
    else:
        print_all(store.read("smoke").where(F.col("run_at") == now).select("name", "success", "status_code", "content_type", F.array_join("failure_reasons", ", ").alias("failed")))
        print(*(f"{k} {v}" for k, v in counts.items()), sep="\n")
    return counts["exit_code"]


def import_catalog(store: Store, path: str, now: float, console: str | None) -> dict:
    """Routers, transports, lease sets and address-book targets of a folder, in one commit; returns how many targets the
    catalog keeps and how many became stale."""
    spark = store.spark
    r, ls = (cut(x) for x in records.read_catalog(spark, path, console))
    with store.commit() as c:
        for name, new, put in (("routers", r, merge.upsert_routers), ("leasesets", ls, merge.upsert_leasesets)):
            old = c.read(name)
            kinds = dict(old.dtypes)
            new = new.select(*[F.col(x).cast(kinds[x]).alias(x) for x in old.columns if x in new.columns], F.lit("").alias("i2p_dns_name"), F.lit("netdb").alias("source"), F.lit(now).alias("updated_at"))
            c.merge(name, new, put)
        c.merge("transports", r.select("ident_hash_hex"), lambda stored, parents: merge.replace_children(stored, records.transports(r), parents))
        known = relational.destinations(c.read("routers"), c.read("leasesets")).select("ident_hash_hex", F.lit("").alias("i2p_dns_name"))
        targets, seen = merge.reconcile(merge.insert_targets(c.read("targets"), known, "addressbook", now), known, now)
        c.write("targets", targets)
    return seen.get


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    now = time.time() if a.now is None else a.now
    spark = session(a.master)
    store = Store(spark, a.store)
    book = lambda: address_book(store.read("discoveries"), store.read("routers"), store.read("leasesets"))
    if a.action == "sweep":
        if a.dry_run:
            print_all(relational.target_queue(store.read("targets"), store.read("discoveries"), a.mode, now, limit=a.count))
        else:
            sweep(store, _fetcher(a), now, a.mode, a.count, a.crawl_depth, a.delay).groupBy("reachable").count().show()
    elif a.action == "reprobe":
        rounds = review.heal(store, _fetcher(a), now, a.learn, a.limit, a.delay) if a.learn else [review.reprobe(store, _fetcher(a), now, a.limit, a.delay)]
        for n in rounds:
            print(*(f"{k} {v}" for k, v in n.items()), sep=", ")
    elif a.action == "analyze":
        todo = relational.pending_analyses(store.read("discoveries"), store.read("targets"), a.mode, now, a.limit)
        found = cut(enrich.analyse(todo, _fetcher(a), enrich.Patient(enrich.HttpModel(a.model_url, a.model))))
        rows, done = merge.update_analysis(store.read("discoveries"), store.read("targets"), found, now)
        with store.commit() as c:
            c.write("discoveries", rows)
            c.write("targets", done)
        print(f"analysed {found.count()}")
    elif a.action == "translate":
        todo = relational.pending_translations(store.read("discoveries"), limit=a.limit)
        found = cut(enrich.translate(todo, enrich.Patient(enrich.HttpModel(a.model_url, a.model))))
        store.write("discoveries", merge.update_summaries(store.read("discoveries"), found))
        print(f"translated {found.count()}")
    elif a.action == "show":
        rows = relational.language_fallback(book(), store.read("discoveries"))
        rows = rows.where("needs_review = 1") if a.needs_review else rows
        if a.json:
            print(export.book_json(rows, a.limit))
        else:
            rows = rows.select("dns_name", "content_type", "reachable", "last_probed_utc", "content_summary").orderBy("dns_name")
            print_all(rows.limit(a.limit) if a.limit else rows)
    elif a.action == "query":
        d = store.read("discoveries")
        found = relational.by_hash(d, a.hash) if a.hash else relational.by_name(d, a.dns) if a.dns else relational.summary(d, store.read("routers"), store.read("leasesets"))
        print_all(found)
    elif a.action == "pending":
        d = store.read("discoveries")
        if a.what == "translate":
            print_all(relational.pending_translations(d, limit=a.limit).where(language.needs_translation(F.col("content_summary"))))
        else:
            print_all(relational.pending_analyses(d, store.read("targets"), a.what, now, a.limit))
    elif a.action == "import" and a.kind == "hosts":
        t = store.read("targets")
        generation = (t.agg(F.max("susi_active").alias("g")).first().g or 0) + 1
        store.write("targets", merge.import_entries(t, hosts.read_hosts(spark, a.path), a.book, generation, now))
    elif a.action == "import":
        print(*(f"{k} {v}" for k, v in import_catalog(store, a.path, now, a.console).items()), sep=", ")
    elif a.action == "export":
        export.write_hosts(book(), store.read("targets"), a.path, datetime.datetime.fromtimestamp(now, datetime.UTC).strftime("%a %b %d %H:%M:%S GMT %Y"))
        if a.site:
            from pathlib import Path

            d = store.read("discoveries")
            (Path(a.site) / "browse.html").write_text(export.browse_page(book(), relational.timeline(d), relational.reachability_series(d)))
            (Path(a.site) / "index.html").write_text(export.index_page())
    elif a.action == "report":
        print(export.report(book()))
    elif a.action == "cleanup":
        store.write("discoveries", merge.cleanup(store.read("discoveries"), now, a.max_age_hours))
    elif a.action == "migrate":
        print("moved:", *store.migrate())
    elif a.action == "ready":
        try:
            print(*(f"{k} {v}" for k, v in console.wait_ready(spark, a.console, f"{a.store}/_ready/{uuid.uuid4().hex}", a.wait, a.poll).items()), sep="\n")
        except TimeoutError as e:
            print(e)
            return 5
    elif a.action == "smoke":
        return smoke(store, a, now)
    return 0


if __name__ == "__main__":
    sys.exit(main())
