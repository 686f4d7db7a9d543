"""The store: buckets, commits over several tables, old layouts, streams of upserts."""

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.operators import merge
from waymark.operators.store import SCHEMAS, Store
from waymark.streaming import jobs

from .test_operators import H, discoveries, rows_of, targets


def hashes(n):
    return [f"{i:040X}" for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=8)


def folders(store, table):
    return store.manifest()["tables"][table]["buckets"]


def test_merge_rewrites_touched_buckets_only(spark, store):
    d = discoveries(spark, *[{"ident_hash_hex": h, "status_code": 1, "deep_analysis": f"about {h[-2:]}"} for h in hashes(100)])
    store.write("discoveries", d)
    before = folders(store, "discoveries")
    assert len(before) == 8
    batch = discoveries(spark, {"ident_hash_hex": hashes(100)[7], "status_code": 2, "probed_at": 9.0})
    assert store.merge("discoveries", batch, merge.upsert_discoveries) == 1
    after = folders(store, "discoveries")
    assert set(after) == set(before) and sum(after[b] != before[b] for b in before) == 1
    found = store.read("discoveries")
    assert found.count() == 100 and rows_of(found.where("status_code = 2"), "ident_hash_hex", "deep_analysis") == [(hashes(100)[7], "about 07")]
    assert store.read("discoveries", 1).where("status_code = 2").count() == 0  # the version before is still there
    assert store.merge("discoveries", batch.limit(0), merge.upsert_discoveries) == 0 and store.versions() == [1, 2]
    with pytest.raises(ValueError, match="other keys"):
        store.merge("discoveries", batch, lambda s, b: discoveries(spark, *[{"ident_hash_hex": h} for h in hashes(50)]))
    assert store.versions() == [1, 2] and store.vacuum(1) == 1 and store.versions() == [2] and store.read("discoveries").count() == 100


def test_columns_that_a_batch_lacks_stay(spark, store):
    d = discoveries(spark, {"ident_hash_hex": H[0], "deep_analysis": "long text", "detected_lang": "de", "needs_review": 1, "content_summary": "s"}, {"i2p_dns_name": "x.i2p", "deep_analysis": "other"}).withColumn("extra", F.lit(7).cast("long")).withColumn("when", F.current_date())
    store.write("discoveries", d)
    batch = discoveries(spark, {"ident_hash_hex": H[0], "status_code": 5, "probed_at": 2.0}, {"ident_hash_hex": H[1], "status_code": 6, "probed_at": 2.0}).drop("deep_analysis", "detected_lang", "needs_review", "content_summary").withColumn("only_here", F.lit(1))
    for _ in range(2):  # merging it again changes nothing
        store.merge("discoveries", batch, merge.upsert_discoveries)
        found = store.read("discoveries")
        assert set(found.columns) == set(d.columns)
        got = {r.ident_hash_hex or r.i2p_dns_name: r for r in found.collect()}
        assert len(got) == 3 and (got[H[0]].deep_analysis, got[H[0]].detected_lang, got[H[0]].needs_review, got[H[0]].content_summary, got[H[0]].status_code, got[H[0]].extra) == ("long text", "de", 1, "s", 5, 7)
        assert got["x.i2p"].deep_analysis == "other" and got[H[0]].when is not None
        assert (got[H[1]].deep_analysis, got[H[1]].detected_lang, got[H[1]].needs_review, got[H[1]].extra, got[H[1]].when) == ("", "", 0, 0, None)


def test_stream_keeps_analyses(spark, store, tmp_path):
    store.write("discoveries", discoveries(spark, *[{"ident_hash_hex": h, "deep_analysis": f"a {h}", "title": "T"} for h in hashes(40)]))
    probes = discoveries(spark, *[{"id": i, "ident_hash_hex": h, "status_code": 200, "probed_at": 5.0 + i} for i, h in enumerate(hashes(3))]).drop("deep_analysis", "flags")
    probes.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(probes.schema).parquet(str(tmp_path / "in"))
    before = folders(store, "discoveries")
    jobs.stream_upserts(source, store, str(tmp_path / "cp")).awaitTermination()
    after = folders(store, "discoveries")
    assert 1 <= sum(after[b] != before[b] for b in before) <= 3
    found = store.read("discoveries")
    assert found.where(F.col("deep_analysis") == F.concat(F.lit("a "), "ident_hash_hex")).count() == 40 and found.where("title = 'T'").count() == 40
    assert rows_of(found.where("status_code = 200"), "ident_hash_hex") == [(h,) for h in hashes(3)]
    # the batch again, as after a failure before the stream's own commit: its number is known, so no version is made
    n = store.versions()
    assert store.merge("discoveries", probes, merge.upsert_discoveries, str(tmp_path / "cp"), 0) is None and store.versions() == n
    jobs.stream_upserts(source, store, str(tmp_path / "cp")).awaitTermination()
    assert store.versions() == n


def test_commit_of_several_tables(spark, store):
    r = spark.createDataFrame([(H[0], "caps")], "ident_hash_hex string, caps string")
    kids = lambda *rows: spark.createDataFrame([(h, ip, 1, "SSU2", True, 0.0) for h, ip in rows], schemas.TRANSPORTS)
    with store.commit() as c:
        c.write("routers", r)
        c.write("transports", kids((H[0], "1.1.1.1"), (H[0], "2.2.2.2"), (H[1], "3.3.3.3")))
        assert c.read("routers").count() == 1 and store.read("routers").count() == 0
    assert (store.read("routers").count(), store.read("transports").count(), store.versions()) == (1, 3, [1])
    # a write that breaks off between two tables shows the old state of both
    with pytest.raises(RuntimeError), store.commit() as c:
        c.write("routers", r.limit(0))
        raise RuntimeError
    assert (store.read("routers").count(), store.read("transports").count(), store.versions()) == (1, 3, [1])
    # children are replaced as a whole, also by none
    both = spark.createDataFrame([(H[0],), (H[1],)], "ident_hash_hex string")
    new = kids((H[0], "9.9.9.9"))
    store.write("transports", merge.replace_children(store.read("transports"), new, both))
    assert rows_of(store.read("transports"), "ident_hash_hex", "ip") == [(H[0], "9.9.9.9")]
    # two writers: the later one fails
    with pytest.raises(OSError, match="another writer"), store.commit() as c:
        store.write("routers", r)
        c.write("routers", r)


def test_layout_before_manifests(spark, store):
    old = discoveries(spark, {"id": 1, "ident_hash_hex": H[0], "title": "old"}, {"id": 2, "ident_hash_hex": H[0], "title": "new"}).drop("deep_analysis", "detected_lang", "flags", "needs_review").withColumn("status_code", F.col("status_code").cast("string"))
    old.write.parquet(f"{store.folder}/discoveries/v1")
    old.write.parquet(f"{store.folder}/discoveries/v2")
    spark.createDataFrame([(H[0], 3)], "ident_hash_hex string, num_leases int").write.parquet(f"{store.folder}/leasesets/v1")
    targets(spark, {"i2p_dns_name": "a.i2p"}).drop("crawl_depth", "provenance_chain", "susi_active").write.parquet(f"{store.folder}/targets/v1")
    found = store.read("discoveries")
    assert found.dtypes == spark.createDataFrame([], SCHEMAS["discoveries"]).dtypes
    assert rows_of(found, "deep_analysis", "detected_lang", "flags", "needs_review", "title") == [("", "", "[]", 0, "new"), ("", "", "[]", 0, "old")]
    assert store.differing("discoveries") == [("status_code", "string", "int")] and store.differing("routers") == []
    assert rows_of(store.read("leasesets"), "num_leases", "created_at", "source") == [(3, 0.0, "")]
    assert rows_of(store.read("targets"), "i2p_dns_name", "crawl_depth", "provenance_chain") == [("a.i2p", 0, "")]
    # the present layout: in one commit, one row a hash and way of probing
    assert store.migrate() == ["discoveries", "targets", "leasesets"] and store.migrate() == [] and store.versions() == [1]
    assert rows_of(store.read("discoveries"), "id", "title", "needs_review") == [(2, "new", 0)] and store.differing("discoveries") == []


def test_schemas_of_one_table_differ(spark, store):
    """Buckets that were written before a column came have its default."""
    store.write("discoveries", discoveries(spark, *[{"ident_hash_hex": h} for h in hashes(30)]).drop("deep_analysis"))
    store.merge("discoveries", discoveries(spark, {"ident_hash_hex": hashes(30)[3], "probed_at": 1.0}), lambda s, b: s.where(F.col("ident_hash_hex") != hashes(30)[3]).unionByName(b.withColumn("deep_analysis", F.lit("x")).withColumn("more", F.lit(1)), allowMissingColumns=True))
    found = store.read("discoveries")
    assert rows_of(found.where("deep_analysis <> ''"), "ident_hash_hex", "more") == [(hashes(30)[3], 1)] and found.count() == 30 and found.where("deep_analysis is null").count() == 0
