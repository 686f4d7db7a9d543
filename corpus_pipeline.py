"""The corpus pipeline: toxicity, exact dedup, near duplicates, benchmark decontamination, mixing.

Each stage works on the rows that the one before kept, and returns the columns of documents (the last adds those of the
mix). Stages exchange Parquet tables. Counts, statistics and searches cover all rows of a stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut, held_out, remove, sent_if_small, small_batches, write_stage
from waymark.llm.decontaminate import contamination
from waymark.llm.exact_dedup import exact_dedup
from waymark.llm.mixing import mix_sources
from waymark.llm.ngram_join import near_duplicates
from waymark.llm.toxicity import tag_toxicity

#: Bytes that an id takes in a broadcast; a list beyond the bound on broadcasts is joined by a shuffle.
ID_BYTES = 64


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows that have one of the ids; a null id goes only if null is among them."""
    with small_batches(docs.sparkSession):
        gone = cut(ids.select(F.col("id").alias("gone_id")).distinct())
    return docs.join(sent_if_small(gone, ID_BYTES), docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go, with all rows of their id. It learns from labels outside the held-out quarter."""
    found = tag_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("id"), 4, 2))
    return _without(docs, found.where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to the case of A-Z, the row with the smallest id stays."""
    return exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, the smallest id stays. Rows
    of one id share its fate; null ids stay unless they are linked to others."""
    found = near_duplicates(docs)
    return _without(docs, found.where(~F.col("id").eqNullSafe(F.col("component_id"))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 words of a benchmark item go, with all rows of their id."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document that the mix takes, with its size, its source's target, its copies and the words taken.

    Rows that are alike in id, source and text become one, with the copies of all. Extra columns that are called like
    those of the mix keep their names, and the mix's get `mix_` before theirs, as often as it takes.
    """
    # never null, so that plain equality joins
    names = {"kid": F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), "ktext": F.xxhash64("text", F.lit(3)), "ksource": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))}
    found = mix_sources(docs, carry=names).where("copies > 0").groupBy(*names)
    found = found.agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in names.items()])
    own = own.groupBy(*names).agg(F.first("row").alias("row")).join(found, list(names))
    extra, taken = [], set(docs.columns)
    for c in ("size", "source_size", "target", "copies", "taken"):
        name = c
        while name in taken:
            name = f"mix_{name}"
        taken.add(name)
        extra.append(F.col(c).alias(name))
    return own.select("row.*", *extra)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The toxicity stage is a trained model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each stage's rows are written as Parquet to the shared folder and read again. A
    stage's table goes once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = write_stage(stage(spark, docs, sf_dir), name)
        if last:
            remove(spark, last)
        last = path
    return docs
