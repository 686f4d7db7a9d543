"""Ways to fetch against fake servers: SOCKS, SAM, fall-back, the console."""

import http.server
import json
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from waymark.config import ProxyConfig, TunnelConfig
from waymark.sources import console, records, tunnels
from waymark.sources.fetch import Response, fetch

from .test_operators import rows_of


def serve(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server.server_address[1]


class Threads(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True


class Site(http.server.BaseHTTPRequestHandler):
    """Says its path and host; it also plays an HTTP proxy, whose paths are whole URLs."""

    def do_GET(self):
        body = f"{self.path}|{self.headers['Host']}".encode()
        self.send_response(404 if "missing" in self.path else 200)
        self.send_header("Content-Type", "text/plain")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


class Socks(socketserver.StreamRequestHandler):
    """Connects every name to the site; names that start with `no` are refused."""

    def handle(self):
        import socket

        n = self.rfile.read(2)[1]
        self.rfile.read(n)
        self.wfile.write(b"\x05\x00")
        self.rfile.read(4)
        name = self.rfile.read(self.rfile.read(1)[0])
        self.rfile.read(2)
        if name.startswith(b"no"):
            self.wfile.write(b"\x05\x04\x00\x01" + bytes(6))
            return
        self.wfile.write(b"\x05\x00\x00\x03\x04name\x00\x50" if name.startswith(b"x") else b"\x05\x00\x00\x01" + bytes(6))
        with socket.create_connection(("127.0.0.1", self.server.site)) as out:
            out.sendall(self.connection.recv(65536))
            while part := out.recv(65536):
                self.wfile.write(part)


class Sam(socketserver.StreamRequestHandler):
    def handle(self):
        for line in self.rfile:
            words = line.decode().split()
            self.server.seen.append(line.decode().strip())
            if words[0] == "VERSION":
                self.wfile.write(b"REPLY OK version=3.1\n" if not self.server.refuse else b"REPLY FAIL\n")
            elif words[0] == "basicauth":
                self.wfile.write(b"REPLY OK\nclientName=me\nclientPassword=secret\n")
            elif words[0] == "negotiate":
                self.wfile.write(b"REPLY OK port=7777 \n")
            elif words[0] == "send":
                self.rfile.read(int(words[1].split("=")[1]))
                answer = b"HTTP/1.1 203 Fine\r\nContent-Type: text/html\r\nX-A: b: c\r\n\r\n<p>\xff</p>"
                self.wfile.write(f"receive bytes={len(answer)}\n".encode() + answer)
            elif words[0] == "close":
                return


@pytest.fixture(scope="module")
def ports():
    site, socks, sam = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site), Threads(("127.0.0.1", 0), Socks), Threads(("127.0.0.1", 0), Sam)
    sam.seen, sam.refuse = [], False
    socks.site = serve(site)
    yield {"site": socks.site, "socks": serve(socks), "sam": serve(sam), "server": sam}
    for s in (site, socks, sam):
        s.shutdown()


def closed_port():
    import socket

    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_socks(ports):
    get = tunnels.SocksFetcher("127.0.0.1", ports["socks"], 5)
    r = get("http://a.i2p/page?x=1")
    assert (r.status, r.body, r.headers["Content-Type"], r.error) == (200, b"/page?x=1|a.i2p", "text/plain", "")
    assert get("http://x.i2p/missing").status == 404
    r = get("http://no.i2p/")
    assert r.status == 0 and "answered 4" in r.error
    assert get("http:///").status == 0 and get("http://" + "a" * 300 + "/").status == 0
    assert tunnels.SocksFetcher("127.0.0.1", closed_port(), 2)("http://a.i2p/").status == 0


def test_sam(ports):
    get = tunnels.SamFetcher("127.0.0.1", ports["sam"], 5)
    r = get("http://a.i2p/p?q=1")
    assert (r.status, r.body, r.headers) == (203, b"<p>\xff</p>", {"Content-Type": "text/html", "X-A": "b: c"})
    assert ports["server"].seen[0].startswith("VERSION 3.1.0 client=") and "basicauth" in ports["server"].seen
    s = tunnels.SamSession("127.0.0.1", ports["sam"], 5)
    assert s.credentials() == ("me", "secret") and s.tunnel("own", "me", "secret") == 7777
    s.close()
    assert any(x.startswith("negotiate destname=own style=client destination=me:secret ") for x in ports["server"].seen)
    ports["server"].refuse = True
    r = get("http://a.i2p/")
    assert r.status == 0 and "refused the version" in r.error
    ports["server"].refuse = False
    assert tunnels.SamFetcher("127.0.0.1", closed_port(), 2)("http://a.i2p/").status == 0
    assert tunnels.http_answer(b"nonsense") == (0, {}, b"")


def test_fall_back_to_the_proxy(ports):
    c = TunnelConfig(ProxyConfig("127.0.0.1", ports["site"], 5), "127.0.0.1", ports["socks"])
    get = tunnels.fetcher("socks", c)
    assert get("http://a.i2p/x").body == b"/x|a.i2p"
    assert get("http://no.i2p/x").body == b"http://no.i2p/x|no.i2p"  # the proxy's answer
    down = tunnels.fetcher("socks", TunnelConfig(ProxyConfig("127.0.0.1", closed_port(), 5), "127.0.0.1", closed_port()))
    r = down("http://a.i2p/")
    assert r.status == 0 and r.error.count("refused") == 2
    first = tunnels.FirstThatAnswers([lambda u: 1 / 0, lambda u: Response(error="b"), lambda u: Response(418)])
    assert first("u").status == 418
    with pytest.raises(ValueError, match="via must be"):
        tunnels.fetcher("smoke-signals")


def test_web_source(spark, ports):
    tunnels.register(spark)
    urls = [f"http://h{i}.i2p/{i}" for i in range(7)] + ["http://no.i2p/z"]
    web = spark.read.format("waymark_web").option("urls", json.dumps(urls)).option("partitions", "3").option("socksPort", str(ports["socks"])).option("proxyPort", str(ports["site"])).option("timeout", "5").load()
    assert web.rdd.getNumPartitions() == 3
    got = {r.url: r for r in web.collect()}
    assert set(got) == set(urls) and all(r.status == 200 for r in got.values()) and bytes(got[urls[3]].body) == b"/3|h3.i2p"
    assert bytes(got["http://no.i2p/z"].body) == b"http://no.i2p/z|no.i2p"
    assert spark.read.format("waymark_web").option("urls", "[]").load().count() == 0
    # the same fetchers behind the operator for tables
    t = spark.createDataFrame([(u,) for u in urls[:2]], "url string")
    assert rows_of(fetch(t, tunnels.SocksFetcher("127.0.0.1", ports["socks"], 5)), "url", "status") == [(u, 200) for u in urls[:2]]


def test_settings():
    c = TunnelConfig.of({"socks_port": "99", "proxy_host": "p", "timeout": "3"})
    assert (c.socks_port, c.proxy.host, c.proxy.timeout, c.sam_timeout) == (99, "p", 3.0, 3.0)
    for bad in ({"socks_port": "0"}, {"sam_timeout": "0"}, {"nonsense": "1"}, {"sam_host": ""}):
        with pytest.raises(ValueError):
            TunnelConfig.of(bad)


class Console(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = self.server.pages.get(self.path)
        self.send_response(200 if body is not None else 404)
        self.end_headers()
        self.wfile.write((body(self.server) if callable(body) else body or "").encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def fake_console():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Console)
    s.pages, s.looks = {}, 0
    yield s, f"http://127.0.0.1:{serve(s)}"
    s.shutdown()


RAW = bytes(range(20))
NAME = "AAECAwQFBgcICQoLDA0ODxAREhM"


def test_catalog_falls_back_to_the_console(spark, tmp_path, fake_console):
    server, url = fake_console
    empty = tmp_path / "netdb"
    empty.mkdir()
    server.pages = {"/peers": f"<a href='/x?{'ab' * 20}'>{'0' * 40}</a>", "/netdb": f"<a href='{NAME}.rtr'>"}
    r, ls = records.read_catalog(spark, str(empty), url)
    assert rows_of(r, "ident_hash_hex", "caps", "key_type") == [("AB" * 20, "sidebar", 1)] and ls.count() == 0
    server.pages[console.PAGES["xhr"]] = f"<td>{'cd' * 20}</td> filename={NAME}.ls64"
    r, _ = records.read_catalog(spark, str(empty), url)
    assert rows_of(r, "ident_hash_hex", "caps") == [(RAW.hex().upper(), "scraped"), ("CD" * 20, "scraped")]
    server.pages = {"/netdb": f"<a href='{NAME}.rtr'> <a href='odd.ls64'>"}
    import hashlib

    r, _ = records.read_catalog(spark, str(empty), url)
    assert rows_of(r, "ident_hash_hex", "caps") == sorted([(RAW.hex().upper(), "R"), (hashlib.sha1(b"odd").hexdigest().upper(), "R")])
    assert records.transports(r).count() == 0
    server.pages = {}
    assert records.read_catalog(spark, str(empty), url)[0].count() == 0
    # files come first
    (empty / f"routerInfo-{NAME}=.rtr").write_bytes(b"\x01" + bytes(400))
    server.pages = {"/peers": "ab" * 20}
    assert rows_of(records.read_catalog(spark, str(empty), url)[0], "ident_hash_hex") == [(RAW.hex().upper(),)]


def test_console_source(spark, fake_console):
    server, url = fake_console
    server.pages = {"/": "home", "/peers": "peers"}
    got = {r.kind: r for r in console.read_console(spark, f"{url},http://127.0.0.1:{closed_port()}", timeout=3).where(F.col("url").startswith(url)).collect()}
    assert set(got) == set(console.PAGES) and (got["home"].html, got["peers"].status, got["netdb"].status) == ("home", 200, 404)
    with pytest.raises(Exception, match="unknown pages"):
        console.read_console(spark, url, "nonsense").collect()


def health_page(server):
    server.looks += 1
    cells = [""] * 50
    ready = server.looks > 2
    cells[20], cells[26], cells[28], cells[32] = "20 / 30" if ready else "0 / 30", "5", "500", "6" if ready else "0"
    return "".join(f"<td>{c}</td>" for c in cells)


def test_waiting_is_a_stream_that_ends(spark, tmp_path, fake_console):
    server, url = fake_console
    server.pages = {"/": "".join(f"<td>{c}</td>" for c in ("", "2.5", "", "3 hours", "", "1.0 / 2.0")), "/peers": health_page}
    row = console.wait_ready(spark, url, str(tmp_path / "cp"), timeout=60, poll=1)
    assert row["is_ready"] and row["peers_connected"] == 20 and server.looks >= 3 and not spark.streams.active
    server.looks = -10_000
    with pytest.raises(TimeoutError):
        console.wait_ready(spark, url, str(tmp_path / "cp2"), timeout=3, poll=1)
    assert not spark.streams.active
