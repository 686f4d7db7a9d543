"""Fetching destinations: a protocol, an offline fake, and operators that use it a partition at a time."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robots

RESPONSE = "url string, status int, body binary, content_type string, headers map<string,string>, elapsed double, error string"
#: Paths that an inspection tries.
COMMON_PATHS = ("/", "/index.html", "/robots.txt", "/sitemap.xml", "/favicon.ico", "/.well-known/dnt-policy.txt", "/admin/", "/login", "/wp-login.php", "/api/", "/api/v1/", "/feed", "/rss", "/atom.xml", "/contact")


@dataclass
class Response:
    status: int = 0
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)
    elapsed: float = 0.0
    error: str = ""

    @property
    def ok(self) -> bool:
        return 200 <= self.status < 400


class Fetcher(Protocol):
    """Fetches one URL; it is sent to executors, so it must pickle. It may raise."""

    def __call__(self, url: str) -> Response: ...


@dataclass
class ProxyFetcher:
    """Over an HTTP proxy. Statuses of 400 and more are kept as they are."""

    proxy: str = "http://127.0.0.1:4444"
    timeout: float = 120.0

    def __call__(self, url: str) -> Response:
        import urllib.error
        import urllib.request

        opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": self.proxy, "https": self.proxy}))
        try:
            with opener.open(url, timeout=self.timeout) as r:
                return Response(r.status, r.read(), dict(r.headers.items()))
        except urllib.error.HTTPError as e:
            return Response(e.code, e.read(), dict(e.headers.items()))


@dataclass
class Offline:
    """Answers from a dict of url to body; other URLs are not found."""

    bodies: dict[str, bytes]
    content_type: str = "text/html"

    def __call__(self, url: str) -> Response:
        body = self.bodies.get(url)
        return Response(404, b"", {}) if body is None else Response(200, body, {"Content-Type": self.content_type})


@dataclass
class Retrying:
    """Tries again after failures, waiting base, twice base, ... seconds; after so many failures in a row it rests."""

    inner: Fetcher
    attempts: int = 3
    base: float = 0.5
    rest_after: int = 5
    rest: float = 60.0
    _failed: int = 0
    _until: float = 0.0

    def __call__(self, url: str) -> Response:
        if time.monotonic() < self._until:
            return Response(error="resting after failures")
        last = Response()
        for attempt in range(self.attempts):
            try:
                last = self.inner(url)
            except Exception as e:  # noqa: BLE001  a probe never fails its task
                last = Response(error=str(e) or type(e).__name__)
            if last.status:
                self._failed = 0
                return last
            if attempt + 1 < self.attempts:
                time.sleep(self.base * 2**attempt)
        self._failed += 1
        if self._failed >= self.rest_after:
            self._until, self._failed = time.monotonic() + self.rest, 0
        return last


def fetch(urls: DataFrame, fetcher: Fetcher, delay: float = 0.0, column: str = "url") -> DataFrame:
    """Responses of URLs. Each partition has its own fetcher and waits delay seconds between requests, so the number of
    partitions is the number of requests at a time. An error is a row with status 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            rows = []
            for url in batch[column]:
                if delay and not first:
                    time.sleep(delay)
                first, began = False, time.monotonic()
                try:
                    r = fetcher(url)
                except Exception as e:  # noqa: BLE001
                    r = Response(error=str(e) or type(e).__name__)
                rows.append((url, r.status, r.body, r.headers.get("Content-Type", ""), r.headers, r.elapsed or time.monotonic() - began, r.error))
            yield pd.DataFrame(rows, columns=["url", "status", "body", "content_type", "headers", "elapsed", "error"])

    return urls.select(column).mapInPandas(run, RESPONSE)


def fetch_paths(hosts: DataFrame, fetcher: Fetcher, paths: tuple[str, ...] = COMMON_PATHS) -> DataFrame:
    """Each path of each host: status, length, type, time. The paths are a stated list, exploded on each host."""
    urls = hosts.select(F.explode(F.transform(F.array(*map(F.lit, paths)), lambda p: F.concat(F.lit("http://"), F.col("host"), p))).alias("url"))
    return fetch(urls, fetcher).select("url", "status", F.octet_length("body").alias("body_length"), "content_type", F.round("elapsed", 3).alias("elapsed_sec"), "error")


def robots_policies(hosts: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(host, policy) of distinct hosts, each fetched once; null without a robots text."""
    urls = hosts.select("host").distinct().withColumn("url", F.concat(F.lit("http://"), "host", F.lit("/robots.txt")))
    got = fetch(urls, fetcher).select("url", "status", "body")
    policy = F.when((F.col("status") == 200) & (F.octet_length("body") > 0), robots.rules(F.decode("body", "UTF-8")))
    return urls.join(got, "url").select("host", policy.alias("policy"))


def network_up(spark: SparkSession, fetcher: Fetcher, well_known: list[str]) -> bool:
    """Whether any of some well-known URLs answers."""
    rows = fetch(spark.createDataFrame([(u,) for u in well_known], "url string"), fetcher)
    return bool(rows.agg(F.bool_or(F.col("status") > 0).alias("up")).first().up)


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """Smoke targets of a JSON file; those without a url are skipped, a label is the name or the url's last part."""
    shape = "targets array<struct<url:string,label:string,name:string,description:string,proxy_requirement:string>>"
    t = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("targets").alias("t")).select("t.*").where(F.coalesce("url", F.lit("")) != "")
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(F.regexp_replace("url", "/+$", ""), "/", -1), r"(?<=.)\.[^.]*$", ""), "^$", "site")
    label = F.coalesce(F.nullif("label", F.lit("")), F.nullif("name", F.lit("")), stem)
    return t.select(label.alias("label"), "url", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("proxy_requirement", F.lit("")).alias("proxy_requirement"))


def prompt(template: str, body: DataFrame, column: str = "body") -> DataFrame:
    """A prompt for each body: the template with its placeholder filled."""
    return body.withColumn("prompt", F.replace(F.lit(template), F.lit("{{BODY}}"), F.col(column)))
