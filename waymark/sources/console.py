"""Console pages: a source that reads and polls them, hashes of routers, table cells, health."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.scalars import filled, hash_of_file_name, hash_of_link, readiness

#: The console's pages, and what routers are marked with that each of them names, in order of preference.
PAGES = {"home": "/", "peers": "/peers", "xhr": "/xhr1.jsp?requestURI=/peers.jsp", "netdb": "/netdb"}
STUBS = {"xhr": "scraped", "peers": "sidebar", "netdb": "R"}
PAGE = "kind string, url string, status int, html string, read_at double"

#: Which table cell (from 1) of the home and peers pages holds what.
HOME = {"version": 2, "uptime": 4, "rate": 6}
PEERS = {"peers": 21, "floodfills": 27, "known": 29, "tunnels": 33, "ntcp": 42, "ssu": 47}


def cells(html: Column) -> Column:
    """Texts of the table cells of a page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " ")))


def hashes(html: Column) -> Column:
    """Distinct 40-digit hashes of a page, and those that 28-character base64 names spell, in lower case."""
    plain = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)(?<![0-9a-f])([0-9a-f]{40})(?![0-9a-f])"), F.lit(1)), lambda h: F.lower(h))
    named = F.transform(F.regexp_extract_all(html, F.lit(r"(?<![A-Za-z0-9~\-])([A-Za-z0-9~\-]{27}=)"), F.lit(1)), lambda n: F.lower(F.hex(F.try_to_binary(F.translate(n, "-~", "+/"), F.lit("base64")))))
    return F.array_sort(F.array_distinct(F.concat(plain, F.filter(named, lambda h: F.length(h) == 40))))


def file_hashes(html: Column, any_name: bool = False) -> Column:
    """Hashes that names of linked record files spell, in lower case. any_name: a name that spells none counts by its SHA-1."""
    names = F.regexp_extract_all(html, F.lit(r"""(?:href|filename)[="'>\s]+([A-Za-z0-9+/=_~-]+)\.(?:rtr|ls64)"""), F.lit(1))

    def own(name: Column) -> Column:
        return F.lower(hash_of_link(name)) if any_name else filled(F.lower(hash_of_file_name(F.concat(name, F.lit(".rtr")))))

    return F.array_distinct(F.array_compact(F.transform(names, own)))


def stub_routers(pages: DataFrame) -> DataFrame:
    """A router for each hash that console pages (kind, html) name.

    Of the kinds in STUBS only the first counts that names any: the peers that the page loads by script, then what its
    frame links to, then the listing of record files, where a file's name that spells no hash counts by its SHA-1.
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(STUBS) for x in (k, i)])
    caps = F.create_map(*[F.lit(x) for pair in STUBS.items() for x in pair])
    html = F.coalesce("html", F.lit(""))
    named = F.when(F.col("kind") == "netdb", file_hashes(html, True)).otherwise(F.array_union(hashes(html), file_hashes(html)))
    found = pages.where(F.col("kind").isin(*STUBS)).select(order[F.col("kind")].alias("rank"), caps[F.col("kind")].alias("caps"), F.explode(named).alias("h")).where(F.col("h") != "0" * 40)
    best = found.agg(F.min("rank").alias("best"))
    found = found.join(F.broadcast(best), F.col("rank") == F.col("best")).select("h", "caps").distinct()
    return found.select(F.upper("h").alias("ident_hash_hex"), "caps", F.lit(1).alias("key_type"), F.lit(0).alias("bandwidth_kbps"))


def read_page(base: str, kind: str, timeout: float) -> tuple:
    """A console page as a row of PAGE; one that can't be read has status 0."""
    url = base.rstrip("/") + PAGES[kind]
    try:
        with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(url, timeout=timeout) as r:
            return kind, url, r.status, r.read().decode("utf-8", "replace"), time.time()
    except urllib.error.HTTPError as e:
        return kind, url, e.code, e.read().decode("utf-8", "replace"), time.time()
    except (OSError, ValueError):
        return kind, url, 0, None, time.time()


class Page(InputPartition):
    def __init__(self, base: str, kind: str):
        self.base, self.kind = base, kind


class ConsoleReader(DataSourceReader):
    """A partition for each console and page."""

    def __init__(self, bases: list[str], kinds: list[str], timeout: float):
        self.bases, self.kinds, self.timeout = bases, kinds, timeout

    def partitions(self) -> list[Page]:
        return [Page(b, k) for b in self.bases for k in self.kinds]

    def read(self, part: Page) -> Iterator[tuple]:
        yield read_page(part.base, part.kind, self.timeout)


class ConsolePolls(SimpleDataSourceStreamReader):
    """Each micro-batch is one look at the pages; the offset counts the looks. Pages of a look that a restarted query asks
    for again are read anew, as a console has no past."""

    def __init__(self, bases: list[str], kinds: list[str], timeout: float):
        self.bases, self.kinds, self.timeout = bases, kinds, timeout

    def initialOffset(self) -> dict:
        return {"look": 0}

    def _look(self) -> Iterator[tuple]:
        return iter([read_page(b, k, self.timeout) for b in self.bases for k in self.kinds])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self._look(), {"look": start["look"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._look() if end["look"] > start["look"] else iter([])

    def commit(self, end: dict) -> None:
        pass


class ConsoleSource(DataSource):
    """`spark.read` or `spark.readStream` with format("waymark_console"): pages of consoles (option `urls`, with commas),
    of the kinds in PAGES (option `kinds`, all by default)."""

    @classmethod
    def name(cls) -> str:
        return "waymark_console"

    def schema(self) -> str:
        return PAGE

    def _settings(self) -> tuple[list[str], list[str], float]:
        kinds = self.options.get("kinds", ",".join(PAGES)).split(",")
        if unknown := set(kinds) - set(PAGES):
            raise ValueError(f"unknown pages: {', '.join(sorted(unknown))}")
        return self.options.get("urls", "http://127.0.0.1:7657").split(","), kinds, float(self.options.get("timeout", 10))

    def reader(self, schema) -> ConsoleReader:
        return ConsoleReader(*self._settings())

    def simpleStreamReader(self, schema) -> ConsolePolls:
        return ConsolePolls(*self._settings())


def read_console(spark: SparkSession, urls: str, kinds: str = ",".join(PAGES), timeout: float = 10) -> DataFrame:
    spark.dataSource.register(ConsoleSource)
    return spark.read.format("waymark_console").option("urls", urls).option("kinds", kinds).option("timeout", str(timeout)).load()


def wait_ready(spark: SparkSession, url: str, checkpoint: str, timeout: float = 600, poll: float = 30) -> dict:
    """The health of a router once it is ready: a stream of looks at its console that ends then, or with a TimeoutError."""
    spark.dataSource.register(ConsoleSource)
    looks = spark.readStream.format("waymark_console").option("urls", url).option("kinds", "home,peers").load()
    ready: list[dict] = []

    def judge(batch: DataFrame, _: int) -> None:
        # one console, so one row
        pages = batch.groupBy().agg(F.coalesce(F.max(F.when(F.col("kind") == "home", F.col("html"))), F.lit("")).alias("home"), F.coalesce(F.max(F.when(F.col("kind") == "peers", F.col("html"))), F.lit("")).alias("peers"))
        row = health(pages).drop("home", "peers", "h", "p").first()
        if row.is_ready:
            ready.append(row.asDict())

    query = looks.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, int(poll * 1000))} milliseconds").start()
    try:
        end = time.monotonic() + timeout
        while not ready and time.monotonic() < end:
            if query.awaitTermination(min(1.0, poll)):
                break
    finally:
        query.stop()
    if not ready:
        raise TimeoutError(f"not ready after {timeout:.0f} seconds")
    return ready[0]


def uptime_seconds(text: Column) -> Column:
    """Seconds of a text like `2 days 3 hours 4 min 5 sec`."""
    part = lambda p: F.coalesce(F.regexp_extract(text, rf"(?i)(\d+)\s*{p}", 1).try_cast("long"), F.lit(0))
    return part("d") * 86400 + part("h") * 3600 + part("m") * 60 + part("s")


def health(pages: DataFrame) -> DataFrame:
    """Health of routers from their console pages (home, peers): numbers, readiness and a label."""
    at = lambda c, i: F.try_element_at(c, F.lit(i))
    number = lambda c, g=1: F.coalesce(F.regexp_extract(c, r"([\d.]+)\s*/\s*([\d.]+)", g).try_cast("double"), F.lit(0.0))
    whole = lambda c: F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(0))
    x = pages.withColumn("h", cells(F.col("home"))).withColumn("p", cells(F.col("peers")))
    x = x.select(
        *pages.columns, F.coalesce(at(F.col("h"), HOME["version"]), F.lit("")).alias("version"), uptime_seconds(F.coalesce(at(F.col("h"), HOME["uptime"]), F.lit(""))).alias("uptime_seconds"),
        number(at(F.col("h"), HOME["rate"])).alias("in_kbps"), number(at(F.col("h"), HOME["rate"]), 2).alias("out_kbps"),
        number(at(F.col("p"), PEERS["peers"])).cast("int").alias("peers_connected"), number(at(F.col("p"), PEERS["peers"]), 2).cast("int").alias("peers_target"),
        whole(at(F.col("p"), PEERS["tunnels"])).alias("client_tunnels"), whole(at(F.col("p"), PEERS["known"])).alias("netdb_known"), whole(at(F.col("p"), PEERS["floodfills"])).alias("floodfills"),
        F.greatest(whole(at(F.col("p"), PEERS["ntcp"])), whole(at(F.col("p"), PEERS["ssu"]))).alias("server_tunnels"),
    )
    score = readiness(F.col("peers_connected"), F.col("peers_target"), F.col("client_tunnels"), F.col("uptime_seconds"))
    label = F.when(F.col("readiness") < 0.1, "down").when(F.col("readiness") < 0.3, "booting").when(F.col("readiness") < 0.6, "reconnecting").otherwise("ready")
    ready = (F.col("readiness") >= 0.3) & (F.col("peers_connected") >= 8) & (F.col("client_tunnels") >= 2)
    return x.withColumn("readiness", F.round(score, 6)).withColumn("state", label).withColumn("is_ready", ready)
