"""The corpus pipeline on small tables."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def tables(spark, tmp_path):
    rnd = random.Random(0)
    clean = [f"word{i}" for i in range(2000)]
    say = lambda n: " ".join(rnd.choice(clean) for _ in range(n))
    item = say(14)
    rows, labels = [], []
    for i in range(240):
        w = say(60).split()
        toxic = i % 6 == 0
        for k in range(3 * toxic):
            w[rnd.randrange(60)] = rnd.choice(["vileone", "vileness", "nastier"])
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    base = say(80)
    near = base.split()
    near[40] = "changed"
    rows += [(1001, base, "en", "s1", 0), (1002, base.upper(), "en", "s1", 0), (1003, " ".join(near), "en", "s1", 0), (1004, say(20) + " " + item + " " + say(9), "en", None, 0), (1005, "all vileone nastier", "en", "s2", 0), (1006, None, None, None, None), (None, say(30), "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id for r in docs.collect()}
    assert 1005 not in seen["toxicity"] and {1001, 1002, 1003, 1004, 1006, None} <= seen["toxicity"]
    assert len(seen["toxicity"] & set(range(0, 240, 6))) == 0 and len(seen["toxicity"] & set(range(240))) == 200
    assert seen["exact_dedup"] == seen["toxicity"] - {1002}
    assert seen["near_dedup"] == seen["exact_dedup"] - {1003}
    assert seen["decontamination"] == seen["near_dedup"] - {1004}
    mixed = pipeline.STAGES[-1][1](spark, docs, tables)
    assert mixed.columns == [*columns, "size", "source_size", "target", "copies", "taken"]
    rows = mixed.collect()
    assert rows and all(1 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)


def test_mix_of_repeated_rows(spark, tables):
    """300 rows of one id don't take more than the target; columns with the mix's names stay."""
    rows = [(7, "one two three four five six seven eight nine ten", "a", 1, "x")] * 300 + [(i, f"word{i} and " * 5, "b", 2, "y") for i in range(100, 200)] + [(7, f"text {i}", "c", 3, "z") for i in range(40)] + [(None, None, None, None, None), (None, "no id", "c", 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, mix_size string")
    mixed = pipeline.mix(spark, df, tables)
    assert mixed.columns == [*df.columns, "mix_mix_size", "source_size", "target", "copies", "taken"]
    got = mixed.collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 15
    assert len([r for r in got if r.source == "a"]) == 1 and all(r.taken == r.copies * r.mix_mix_size for r in got)


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert docs.count() == 0


def test_run(spark, tables):
    assert 0 < pipeline.run(spark, tables).count() < 210
