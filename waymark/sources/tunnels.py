"""Fetchers over SOCKS 5 and over SAM, fall-back from one way to another, and a data source that fetches by partitions."""

from __future__ import annotations

import http.client
import json
import socket
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import TunnelConfig
from .fetch import Fetcher, ProxyFetcher, Response

AGENT = "waymark/1"
#: Lines of credentials that a server may send before it is given up.
CREDENTIAL_LINES = 20


def exactly(s: socket.socket, n: int) -> bytes:
    data = b""
    while len(data) < n:
        part = s.recv(n - len(data))
        if not part:
            raise ConnectionError("the server closed the connection")
        data += part
    return data


def socks_connect(server: tuple[str, int], target: tuple[str, int], timeout: float) -> socket.socket:
    """A connection to target by way of a SOCKS 5 server without a password; the server resolves the name."""
    name = target[0].encode("idna")
    if not 0 < len(name) < 256:
        raise ValueError(f"a name that SOCKS can't carry: {target[0]!r}")
    s = socket.create_connection(server, timeout)
    try:
        s.sendall(b"\x05\x01\x00")
        if exactly(s, 2) != b"\x05\x00":
            raise ConnectionError("the SOCKS server wants another way to log in")
        s.sendall(b"\x05\x01\x00\x03" + bytes([len(name)]) + name + target[1].to_bytes(2, "big"))
        _, code, _, kind = exactly(s, 4)
        if code:
            raise ConnectionError(f"the SOCKS server answered {code}")
        exactly(s, 2 + {1: 4, 4: 16}.get(kind, 0) if kind != 3 else exactly(s, 1)[0] + 2)
        return s
    except BaseException:
        s.close()
        raise


@dataclass
class SocksFetcher:
    """Over a SOCKS 5 server. Every failure is a response of status 0."""

    host: str = "127.0.0.1"
    port: int = 4447
    timeout: float = 120.0

    def __call__(self, url: str) -> Response:
        began, at = time.monotonic(), urlsplit(url)
        try:
            link = http.client.HTTPConnection(at.hostname or "", at.port or 80, timeout=self.timeout)
            link.sock = socks_connect((self.host, self.port), (at.hostname or "", at.port or 80), self.timeout)
            try:
                link.request("GET", (at.path or "/") + (f"?{at.query}" if at.query else ""), headers={"User-Agent": AGENT, "Connection": "close"})
                r = link.getresponse()
                return Response(r.status, r.read(), dict(r.getheaders()), time.monotonic() - began)
            finally:
                link.close()
        except (OSError, http.client.HTTPException, ValueError, UnicodeError) as e:
            return Response(elapsed=time.monotonic() - began, error=str(e) or type(e).__name__)


class SamSession:
    """A line protocol over one connection: version, credentials, a tunnel, and bytes that are sent and received."""

    def __init__(self, host: str, port: int, timeout: float, client: str = AGENT):
        self.socket = socket.create_connection((host, port), timeout)
        self.lines = self.socket.makefile("rb")
        try:
            self.say(f"VERSION 3.1.0 client={client.replace('/', '-')}")
            if "REPLY OK" not in (answer := self.line()):
                raise ConnectionError(f"SAM refused the version: {answer}")
        except BaseException:
            self.close()
            raise

    def say(self, line: str, data: bytes = b"") -> None:
        self.socket.sendall(line.encode() + b"\n" + data)

    def line(self) -> str:
        line = self.lines.readline()
        if not line:
            raise ConnectionError("SAM closed the connection")
        return line.decode("utf-8", "replace").strip()

    def credentials(self) -> tuple[str, str]:
        """The client's name and password, which follow or come with the answer."""
        self.say("basicauth")
        found: dict[str, str] = {}
        for _ in range(CREDENTIAL_LINES):
            line = self.line()
            if "REPLY FAIL" in line:
                raise ConnectionError(f"SAM refused to log in: {line}")
            for part in line.split():
                name, _, value = part.partition("=")
                if name in ("clientName", "clientPassword"):
                    found[name] = value
            if len(found) == 2:
                return found["clientName"], found["clientPassword"]
        raise ConnectionError("SAM sent no credentials")

    def tunnel(self, name: str, user: str = "", password: str = "", period: int = 120, max_age: int = 3600) -> int | None:
        """The local port of a new tunnel; None if there is none."""
        own = f" destination={user}:{password}" if user and password else ""
        self.say(f"negotiate destname={name} style=client{own} generalErrorNotification=1 period={period} maxAge={max_age}")
        ports = [p.partition("=")[2] for p in self.line().split() if p.startswith("port=")]
        return int(ports[0]) if ports and ports[0].isdigit() else None

    def exchange(self, data: bytes) -> bytes:
        self.say(f"send bytes={len(data)}", data)
        answer = self.line()
        size = answer.partition("receive bytes=")[2].split()
        return self.lines.read(int(size[0])) if size and size[0].isdigit() else b""

    def close(self) -> None:
        try:
            self.say("close")
        except OSError:
            pass
        self.lines.close()
        self.socket.close()


def http_answer(raw: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body of the bytes of an HTTP answer; status 0 if they are none."""
    head, mark, body = raw.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    parts = first.split(" ", 2)
    if not mark or not first.startswith("HTTP/") or len(parts) < 2 or not parts[1].isdigit():
        return 0, {}, b""
    return int(parts[1]), {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in rest) if _}, body


@dataclass
class SamFetcher:
    """Through SAM, a session a request. Every failure is a response of status 0."""

    host: str = "127.0.0.1"
    port: int = 9025
    timeout: float = 60.0

    def __call__(self, url: str) -> Response:
        began, at = time.monotonic(), urlsplit(url)
        try:
            s = SamSession(self.host, self.port, self.timeout)
            try:
                s.credentials()
                path = (at.path or "/") + (f"?{at.query}" if at.query else "")
                raw = s.exchange(f"GET {path} HTTP/1.1\r\nHost: {at.hostname}\r\nUser-Agent: {AGENT}\r\nConnection: close\r\n\r\n".encode())
            finally:
                s.close()
        except (OSError, ValueError) as e:
            return Response(elapsed=time.monotonic() - began, error=str(e) or type(e).__name__)
        status, headers, body = http_answer(raw)
        return Response(status, body, headers, time.monotonic() - began, "" if status else "no answer")


@dataclass
class FirstThatAnswers:
    """Tries one way after the other while the status is 0; the error of a last failure names them all."""

    ways: list[Fetcher]

    def __call__(self, url: str) -> Response:
        errors = []
        for way in self.ways:
            try:
                r = way(url)
            except Exception as e:  # noqa: BLE001  a way that breaks is a way that doesn't answer
                r = Response(error=str(e) or type(e).__name__)
            if r.status:
                return r
            errors.append(r.error)
        return Response(error="; ".join(filter(None, errors)))


def fetcher(via: str = "socks", config: TunnelConfig | None = None, timeout: float | None = None) -> Fetcher:
    """The fetcher of a way: socks (the HTTP proxy where it doesn't answer), sam or http-proxy."""
    c = config or TunnelConfig()
    proxy = ProxyFetcher(f"http://{c.proxy.host}:{c.proxy.port}", timeout or c.proxy.timeout)
    if via == "socks":
        return FirstThatAnswers([SocksFetcher(c.socks_host, c.socks_port, timeout or c.proxy.timeout), proxy])
    if via == "sam":
        return SamFetcher(c.sam_host, c.sam_port, timeout or c.sam_timeout)
    if via == "http-proxy":
        return FirstThatAnswers([proxy])
    raise ValueError(f"via must be socks, sam or http-proxy, not {via}")


class Slice(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls, self.via = json.loads(options["urls"]), options.get("via", "socks")
        self.partitions_, self.delay = int(options.get("partitions", 8)), float(options.get("delay", 0))
        names = {"sockshost": "socks_host", "socksport": "socks_port", "samhost": "sam_host", "samport": "sam_port", "proxyhost": "proxy_host", "proxyport": "proxy_port", "timeout": "timeout"}
        self.config = TunnelConfig.of({names[k.lower()]: v for k, v in options.items() if k.lower() in names})

    def partitions(self) -> list[Slice]:
        return [Slice(self.urls[i :: self.partitions_]) for i in range(min(self.partitions_, len(self.urls)))] or [Slice([])]

    def read(self, part: Slice) -> Iterator[tuple]:
        get = fetcher(self.via, self.config)
        for i, url in enumerate(part.urls):
            if i and self.delay:
                time.sleep(self.delay)
            r = get(url)
            yield url, r.status, r.body, r.headers.get("Content-Type", ""), r.headers, r.elapsed, r.error


class WebSource(DataSource):
    """`spark.read.format("waymark_web")`: the responses of a stated list of URLs (option `urls`, JSON), dealt to so many
    partitions, each with a fetcher of its own (options via, partitions, delay, timeout, and hosts and ports of the ways).
    For URLs of a table use `fetch`."""

    @classmethod
    def name(cls) -> str:
        return "waymark_web"

    def schema(self) -> str:
        return "url string, status int, body binary, content_type string, headers map<string,string>, elapsed double, error string"

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the data sources of this package known to a session."""
    from .console import ConsoleSource

    spark.dataSource.register(WebSource)
    spark.dataSource.register(ConsoleSource)
