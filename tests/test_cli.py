"""The command line over a small store."""

import json

import pytest

from waymark import cli
from waymark.operators.store import Store

from .test_operators import H, discoveries, targets


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write("discoveries", discoveries(spark, {"ident_hash_hex": H[0], "i2p_dns_name": "a.i2p", "reachable": 1, "probed_at": 5.0, "needs_review": 1}, {"ident_hash_hex": H[1], "b32_addr": "y.b32.i2p"}))
    s.write("targets", targets(spark, {"i2p_dns_name": "a.i2p", "ident_hash_hex": H[0], "dest_data": "B" * 30}))
    return s


def run(store, *args):
    return cli.main(["--store", store.folder, "--now", "1000000", *args])


def test_actions(store, tmp_path, capsys):
    assert run(store, "show", "--json") == 0
    assert {r["dns_name"] for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1])} == {"a.i2p", "y.b32.i2p"}
    for args in (["show", "--needs-review"], ["query", "--hash", H[0]], ["query", "--dns", "a.i2p"], ["query"], ["pending", "reachable"], ["pending", "translate"], ["sweep", "--dry-run", "--count", "1"], ["report"]):
        assert run(store, *args) == 0
    assert "# Catalog report" in capsys.readouterr().out
    assert run(store, "export", str(tmp_path / "hosts"), "--site", str(tmp_path)) == 0
    lines = sorted(x for p in (tmp_path / "hosts").glob("part-*") for x in p.read_text().splitlines())
    assert "a.i2p=" + "B" * 30 in lines and "# 2 entries" in lines and (tmp_path / "browse.html").exists()
    (tmp_path / "in.txt").write_text("n.i2p=" + "A" * 64 + "\n")
    assert run(store, "import", "hosts", str(tmp_path / "in.txt")) == 0 and store.read("targets").count() == 2
    assert run(store, "cleanup") == 0 and store.read("discoveries").count() == 1
    (tmp_path / "t.json").write_text('{"targets": []}')
    assert run(store, "smoke", str(tmp_path / "t.json")) == 4


def test_no_row_is_left_out(spark, store, capsys):
    """pending and dry runs print as many rows as there are, or as the limit says."""
    n = 1010
    store.write("discoveries", discoveries(spark, *[{"ident_hash_hex": f"{i:040X}", "i2p_dns_name": f"n{i}.i2p", "reachable": 1, "title": "T", "probed_at": 5.0} for i in range(n)]))
    store.write("targets", targets(spark, *[{"ident_hash_hex": f"{i:040X}", "i2p_dns_name": f"n{i}.i2p"} for i in range(n)]))

    def printed(*args):
        capsys.readouterr()
        assert run(store, *args) == 0
        return sum(".i2p" in line for line in capsys.readouterr().out.splitlines())

    assert printed("pending", "reachable") == n and printed("pending", "reachable", "--limit", "500") == 500
    assert printed("sweep", "--dry-run") == n and printed("sweep", "--dry-run", "--count", "1005") == 1005


def test_needs_an_action():
    with pytest.raises(SystemExit):
        cli.main(["--store", "x"])


def test_catalog_in_one_commit(spark, store, tmp_path, capsys):
    import base64

    from waymark.operators import merge

    from .test_operators import router_bytes, targets

    name = base64.urlsafe_b64encode(bytes(range(20))).decode()
    (tmp_path / "netdb").mkdir()
    (tmp_path / "netdb" / f"{name}.rtr").write_bytes(router_bytes())
    store.write("targets", store.read("targets").unionByName(targets(spark, {"ident_hash_hex": "D" * 40, "source": "addressbook"})))
    n = store.versions()
    assert run(store, "import", "netdb", str(tmp_path / "netdb")) == 0
    assert store.versions() == [*n, n[-1] + 1] and "kept 1, stale 1" in capsys.readouterr().out
    own = bytes(range(20)).hex().upper()
    assert store.read("routers").first().ident_hash_hex == own and {r.ident_hash_hex for r in store.read("transports").collect()} == {own}
    ways = store.read("transports").count()
    assert ways and run(store, "import", "netdb", str(tmp_path / "netdb")) == 0 and store.read("transports").count() == ways
    assert store.read("targets").where(f"source = '{merge.STALE_SOURCE}'").count() == 1


def test_enrichment_and_review_actions(spark, store, tmp_path, capsys):
    import http.server
    import threading

    class Web(http.server.BaseHTTPRequestHandler):
        """A proxy to one page, and a language model."""

        def do_GET(self):
            self.reply(b"<html><title>A blog</title><body><p>Posted by admin in the blog archive. Read more posts and comments here.</p></body></html>")

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            self.reply(json.dumps({"response": '{"site_type": "blog"}' if "JSON" in asked else "In English"}).encode())

        def reply(self, body):
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Web)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"127.0.0.1:{server.server_address[1]}"
    try:
        store.write("discoveries", discoveries(spark, {"id": 1, "ident_hash_hex": H[0], "i2p_dns_name": "a.i2p", "reachable": 1, "needs_review": 1, "title": "T", "detected_lang": "de", "content_summary": "Eine lange Zeile hier", "probed_at": 1.0}))
        model = ["--model", "m", "--model-url", f"http://{at}/api"]
        assert run(store, "translate", *model) == 0 and "translated 1" in capsys.readouterr().out
        assert "In English [original: Eine lange Zeile hier]" in store.read("discoveries").first().content_summary
        assert run(store, "analyze", *model, "--proxy", at) == 0 and "analysed 1" in capsys.readouterr().out
        assert store.read("discoveries").first().deep_analysis == '{"site_type": "blog"}' and store.read("targets").first().last_analyzed_at == 1e6
        assert run(store, "reprobe", "--proxy", at, "--delay", "0") == 0 and "cleared 1" in capsys.readouterr().out
        assert store.read("discoveries").where("probe_mode = 'b32'").first().deep_analysis == '{"site_type": "blog"}'
        (tmp_path / "t.json").write_text('{"targets": [{"url": "http://a.i2p/", "name": "A"}]}')
        assert run(store, "smoke", str(tmp_path / "t.json"), "--proxy", at, "--delay", "0", "--json") in (0, 3)
        assert '"targets_count": 1' in capsys.readouterr().out and store.read("smoke").count() == 1
    finally:
        server.shutdown()
    assert run(store, "migrate") == 0
    assert run(store, "ready", "http://127.0.0.1:9", "--wait", "2", "--poll", "1") == 5
