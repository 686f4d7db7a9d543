"""Smoke runs: stated targets are probed, read, checked and stored; a run's counts come from the pass that writes it."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import pages
from ..functions.scalars import reachable
from ..sources.fetch import Fetcher, fetch
from .extractors import run_builtin
from .merge import EMPTY, upsert_discoveries
from .relational import validate
from .store import Store

#: Exit codes by severity.
CODES = {"preflight": 5, "store": 3, "probe": 1, "extract": 2, "success": 0}
PREVIEW = 200


def results(targets: DataFrame, fetcher: Fetcher, now: float, delay: float = 0.0, dry_run: bool = False) -> DataFrame:
    """A row a target (label, url) in the columns of the smoke table: what came, what it is, its stages and its checks.

    The stages are probe, extract, classify and store, as far as the run came: without an answer there is only the first,
    and a target that fails a check isn't stored. The stage `store` says what the run will do; reruns of the pass agree on it.
    """
    got = targets.select(F.col("label").alias("name"), "url").join(fetch(targets.select("url").distinct(), fetcher, delay), "url")
    x = got.withColumn("text", F.coalesce(F.decode("body", "UTF-8"), F.lit(""))).withColumn("title", pages.title(F.col("text"))).withColumn("raw", F.col("body"))
    x = run_builtin(x.withColumn("body", F.col("text")).withColumn("server_type", F.col("content_type")).drop("content_type"))
    up = F.col("status") > 0
    x = x.select(
        "name", "url", "title", "headers", "links", "raw", "summary_lines", up.alias("probe_ok"), F.col("status").alias("status_code"), F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long").alias("body_length"), "elapsed", F.col("error").alias("stage_error"),
        F.when(up, F.col("content_type")).otherwise("").alias("content_type"), F.array_join(F.slice("summary_lines", 1, 3), "\n").alias("summary"), F.when(up, F.col("needs_review") == 1).otherwise(False).alias("needs_review"), F.when(up, F.col("review_reason")).otherwise("").alias("review_reason"),
    )
    x = validate(x)
    stage = lambda name, ok, detail, sec=F.lit(0.0): F.struct(F.lit(name).alias("name"), ok.alias("ok"), detail.alias("detail"), F.round(sec, 2).alias("elapsed_sec"))
    probed = stage("probe", F.col("probe_ok"), F.when(F.col("probe_ok"), F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).otherwise(F.coalesce(F.nullif("stage_error", F.lit("")), F.lit("no answer"))), F.col("elapsed"))
    kept = F.when(F.lit(dry_run), F.lit("skipped: dry run")).when(F.col("passed"), F.lit("stored")).otherwise(F.concat(F.lit("skipped: "), F.array_join("failed_checks", ", ")))
    rest = F.array(
        stage("extract", F.size("summary_lines") > 0, F.concat(F.size("summary_lines").cast("string"), F.lit(" lines"))), stage("classify", F.col("content_type") != "", F.coalesce(F.nullif("content_type", F.lit("")), F.lit("unknown"))), stage("store", F.col("passed") | F.lit(dry_run), kept),
    )
    names = ("probe_ok", "status_in_range", "body_sufficient", "content_classified", "summary_present", "no_fatal_error")
    checks = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[~F.array_contains("failed_checks", n) for n in names]))
    return x.select(
        F.lit(now).alias("run_at"), "name", "url", F.col("passed").alias("success"), "status_code", "body_length", F.round("elapsed", 2).alias("response_time"), "content_type", F.substring("summary", 1, PREVIEW).alias("summary_preview"),
        F.to_json("links").alias("found_links"), "needs_review", "review_reason", F.when(F.col("probe_ok"), F.concat(F.array(probed), rest)).otherwise(F.array(probed)).alias("stages"), checks.alias("checks"), F.col("failed_checks").alias("failure_reasons"), "title", "summary",
    )


def _probes(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Probe rows of the targets that passed: without a hash, by name."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    known = {
        "id": F.xxhash64("url"), "b32_addr": host, "i2p_dns_name": F.col("name"), "probe_mode": F.lit("dns"), "via_method": F.lit("dns"), "reachable": reachable(F.col("status_code")).cast("int"), "status_code": F.col("status_code"), "body_length": F.col("body_length"), "response_time": F.col("response_time"),
        "title": F.col("title"), "content_type": F.col("content_type"), "content_summary": F.col("summary"), "found_links": F.col("found_links"), "flags": F.lit("[]"), "needs_review": F.col("needs_review").cast("int"), "probed_at": F.col("run_at"),
    }
    return rows.where("success").select(*[known.get(c, F.lit(EMPTY.get(t))).cast(t).alias(c) for c, t in like.dtypes if c != "deep_analysis"])


def run(store: Store, targets: DataFrame, fetcher: Fetcher, now: float, delay: float = 0.0, dry_run: bool = False, preflight_ok: bool = True) -> dict:
    """A smoke run: writes the targets' rows to the table `smoke` and the probes of those that passed to the discoveries, in
    one commit; a dry run writes the rows only. Returns the counts, which are observed while the rows are written: targets,
    passed, failed, elapsed seconds and the exit code."""
    seen = Observation()
    failed = lambda *names: F.exists("stages", lambda s: s["name"].isin(*names) & ~s["ok"])
    sums = F.aggregate("stages", F.lit(0.0), lambda a, s: a + s["elapsed_sec"])
    rows = results(targets, fetcher, now, delay, dry_run)
    rows = rows.observe(
        seen, F.count("*").alias("targets_count"), F.count_if("success").alias("pass_count"), F.count_if(~F.col("success")).alias("fail_count"), F.round(F.coalesce(F.sum(sums), F.lit(0.0)), 2).alias("total_elapsed_sec"),
        F.count_if(failed("probe")).alias("probe"), F.count_if(failed("extract", "classify")).alias("extract"), F.count_if(failed("store")).alias("store"),
    )
    with store.commit() as c:
        earlier = c.read("smoke")
        c.write("smoke_run", rows)
        own = c.read("smoke_run")
        c.write("smoke", earlier.where(F.col("run_at") != now).unionByName(own.select(*earlier.columns)))
        if not dry_run:
            c.merge("discoveries", _probes(own, c.read("discoveries")), upsert_discoveries)
    n = dict(seen.get)
    code = "preflight" if not preflight_ok else next((k for k in ("store", "probe", "extract") if n[k]), "success")
    return {k: n[k] for k in ("targets_count", "pass_count", "fail_count", "total_elapsed_sec")} | {"exit_code": CODES[code]}


def report(store: Store, now: float, counts: dict) -> str:
    """The JSON report of a run: its counts, and the rows of its targets, which are a stated list."""
    t = store.read("smoke").where(F.col("run_at") == now).orderBy("name", "url")
    own = F.struct(
        "name", "url", "success", F.when(F.col("success"), "PASS").otherwise("FAIL").alias("pass_label"), "status_code", "body_length", F.col("response_time").alias("response_time_sec"), "content_type", "summary_preview",
        F.from_json("found_links", "array<string>").alias("found_links"), "needs_review", "review_reason", "stages", F.struct(F.col("success").alias("passed"), "checks", "failure_reasons").alias("validation"),
    )
    rows = [json.loads(r.j) for r in t.select(F.to_json(own).alias("j")).toLocalIterator()]
    stamp = datetime.datetime.fromtimestamp(now, datetime.UTC).isoformat()
    return json.dumps({"smoke_test": {"timestamp": stamp, **counts, "targets": rows}}, indent=2)


__all__ = ["CODES", "report", "results", "run"]
