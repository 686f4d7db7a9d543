"""Analyses and translations with a stub model."""

import json

import pytest

from waymark.config import ProxyConfig, setting
from waymark.operators import enrich, merge, relational
from waymark.sources.fetch import Offline

from .test_operators import H, discoveries, rows_of, targets


def model(prompt):
    if "bad" in prompt:
        raise OSError("no answer")
    return '```json\n{"site_type": "x"}\n```' if "first" in prompt else "free text" if "JSON" in prompt else "In English"


def test_analyses(spark):
    d = discoveries(spark, {"ident_hash_hex": H[0], "i2p_dns_name": "a.i2p", "reachable": 1}, {"ident_hash_hex": H[1], "b32_addr": "b.b32.i2p", "reachable": 1}, {"ident_hash_hex": H[2], "i2p_dns_name": "c.i2p", "reachable": 1})
    web = Offline({"http://a.i2p/": b"<p>first</p>", "http://b.b32.i2p/": b"<p>second</p>", "http://c.i2p/": b"<p>bad</p>"})
    t = targets(spark, {"ident_hash_hex": H[0]})
    found = enrich.analyse(relational.pending_analyses(d, t, "never_analyzed"), web, model)
    assert {r.ident_hash_hex: json.loads(r.analysis) for r in found.collect()} == {H[0]: {"site_type": "x"}, H[1]: {"raw_analysis": "free text"}}
    rows, done = merge.update_analysis(d, t, found, 3.0)
    assert rows.where("deep_analysis <> ''").count() == 2 and done.first().last_analyzed_at == 3.0


def test_translations(spark):
    d = discoveries(spark, {"reachable": 1, "detected_lang": "de", "content_summary": "Eine lange Zeile\nhttp://x"}, {"reachable": 1, "detected_lang": "de", "content_summary": "a bad line of text"}, {"reachable": 1, "detected_lang": "en", "content_summary": "English here"}, {"reachable": 1, "detected_lang": "fr", "content_summary": "short"})
    new = enrich.translate(relational.pending_translations(d), model)
    assert rows_of(new, "id", "content_summary") == [(0, "[detected_language: de (German)]\nIn English [original: Eine lange Zeile]\nhttp://x")]
    assert merge.update_summaries(d, new).where("content_summary like '%[original:%'").count() == 1


def test_patience():
    calls = []

    def fails(prompt):
        calls.append(prompt)
        raise OSError

    m = enrich.Patient(fails, attempts=2, base=0.0)
    assert m("a") == "" and m("b") == "" and calls == ["a", "a"]
    assert enrich.Patient(str.upper)("a") == "A"


def test_settings(spark):
    table = spark.createDataFrame([("port", "4445"), ("none", None)], "key string, value string")
    assert setting(table, "port", "1") == "4445" and setting(table, "none", "d") == "d" and setting(table, "other") == ""
    assert ProxyConfig().url == "http://127.0.0.1:4444"
    for bad in ({"host": ""}, {"port": 0}, {"timeout": 0}, {"delay": -1}):
        with pytest.raises(ValueError):
            ProxyConfig(**bad)
