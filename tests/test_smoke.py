"""Smoke runs: stages, stored rows, observed counts, the report."""

import json

import pytest

from waymark.operators import smoke
from waymark.operators.store import Store
from waymark.sources.fetch import Response

from .test_operators import discoveries, rows_of
from .test_review import GOOD


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=4)


def web(url):
    if "good" in url:
        return Response(200, GOOD + b" " * 200, {"Content-Type": "text/html"}, 1.25)
    if "small" in url:
        return Response(200, b"<html>x</html>", {"Content-Type": "text/html"}, 0.5)
    return Response(elapsed=2.0, error="no route")


def test_run(spark, store):
    t = spark.createDataFrame([("Good", "http://good.i2p/"), ("Small", "http://small.i2p/"), ("Down", "http://down.i2p/x")], "label string, url string")
    store.write("discoveries", discoveries(spark, {"i2p_dns_name": "other", "deep_analysis": "kept"}))
    counts = smoke.run(store, t, web, 1000.0)
    assert counts == {"targets_count": 3, "pass_count": 1, "fail_count": 2, "total_elapsed_sec": 3.75, "exit_code": 3}
    rows = {r.name: r for r in store.read("smoke").collect()}
    assert [s.name for s in rows["Good"].stages] == ["probe", "extract", "classify", "store"] and all(s.ok for s in rows["Good"].stages)
    assert [s.name for s in rows["Down"].stages] == ["probe"] and rows["Down"].stages[0].detail == "no route" and not rows["Down"].success
    assert rows["Small"].failure_reasons and rows["Small"].stages[3].detail.startswith("skipped: body_sufficient") and not rows["Small"].checks["body_sufficient"] and rows["Small"].checks["probe_ok"]
    assert rows_of(store.read("discoveries"), "i2p_dns_name", "deep_analysis", "probe_mode") == [("Good", "", "dns"), ("other", "kept", "b32")]
    told = json.loads(smoke.report(store, 1000.0, counts))["smoke_test"]
    assert told["pass_count"] == 1 and told["timestamp"].startswith("1970-01-01T00:16:40") and [x["name"] for x in told["targets"]] == ["Down", "Good", "Small"]
    assert told["targets"][1]["pass_label"] == "PASS" and told["targets"][1]["validation"]["passed"] and told["targets"][1]["stages"][0] == {"name": "probe", "ok": True, "detail": "HTTP 200", "elapsed_sec": 1.25}
    # a later run stands beside the first; the same run again replaces its rows
    for _ in range(2):
        assert smoke.run(store, t.where("label = 'Good'"), web, 2000.0)["exit_code"] == 0
    assert store.read("smoke").groupBy("run_at").count().count() == 2 and store.read("smoke").count() == 4


def test_dry_run_codes_and_nothing(spark, store):
    t = spark.createDataFrame([("Down", "http://down.i2p/"), ("Small", "http://small.i2p/")], "label string, url string")
    assert smoke.run(store, t, web, 1.0, dry_run=True)["exit_code"] == 1 and store.read("discoveries").count() == 0
    assert smoke.run(store, t, web, 1.0, dry_run=True, preflight_ok=False)["exit_code"] == 5
    assert smoke.run(store, t.where("label = 'Small'"), web, 2.0, dry_run=True)["exit_code"] in (0, 2)
    assert smoke.run(store, t.where("false"), web, 3.0) == {"targets_count": 0, "pass_count": 0, "fail_count": 0, "total_elapsed_sec": 0.0, "exit_code": 0}
