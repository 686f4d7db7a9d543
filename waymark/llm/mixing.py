"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sent_if_small

#: Rates and their sums are whole numbers of this fraction, so that sums don't depend on their order.
UNIT = 1_000_000
TOLERANCE = 1e-7
#: Newton steps before each step halves the bracket, which always ends.
NEWTON_STEPS = 40
#: Starts of the rounding that are tried for each source.
PHASES = 32
#: Rows of one source and size that are ranked together.
RANKED = 512
#: Bytes of a row of a source and size.
ROW_BYTES = 160


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _running(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df with the sums of columns over the rows before each, in an order of all rows: ranges of the order are summed
    apart, and only their totals (one row a range) meet in one task."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lower = before(Window.orderBy("_range"))
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(lower), F.lit(0)).alias(f"_{name}") for name in sums])
    own = before(Window.partitionBy("_range").orderBy(*order))
    found = dealt.join(F.broadcast(totals), "_range")
    return found.select(*df.columns, *[(F.col(f"_{name}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(name) for name, c in sums.items()])


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sources (key, source, source_size, docs) with `target`: shares of the total by weight, none above most * source_size.

    Weights repeat over the sources by code point, null last. Sources reach their bound in the order of bound / weight;
    running sums in that order give the level that the others share. Sources stay distributed, however many there are.
    """
    one = sources.withColumn("one", F.lit(1))
    t = _running(one, [F.col("source").asc_nulls_last()], place="one").drop("one")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    t = t.withColumn("w", w.cast("double")).drop("place").withColumn("bound", F.col("source_size").cast("double") * most)
    t = cut(t.withColumn("ratio", F.col("bound") / F.col("w")))
    t = _running(t, [F.col("ratio"), F.col("source").asc_nulls_last()], full="bound", full_w="w")
    sums = t.agg(F.sum("source_size").cast("double").alias("total"), F.sum("w").alias("all_w")).first()
    # the level if all sources before this one are at their bound; the first whose ratio is above it sets the level
    t = cut(t.withColumn("level", (F.lit(sums.total).cast("double") - F.col("full")) / (F.lit(sums.all_w).cast("double") - F.col("full_w"))))
    level = t.agg(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level")))["level"].alias("level")).first().level
    return t.select("key", "source", "source_size", "docs", F.least(F.col("bound"), F.col("w") * F.lit(float("inf") if level is None else level)).alias("target"))


def _rate(size: Column, docs: Column, source_size: Column, tilt: Column, most: int) -> tuple[Column, Column]:
    """The size over its mean, and the rate in units: exp(tilt * that), never above most."""
    z = size * docs / source_size
    return z, F.least(F.lit(most * UNIT), F.round(F.exp(F.least(F.lit(20.0), tilt * z)) * UNIT).cast("long"))


def tilts(classes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """goals (key, source, source_size, docs, target) with the `tilt` that meets each target.

    The dual of the entropy balance is convex and falls apart by source: each Newton step sums every source's words at
    the present tilt, and the slope, over the table of (key, size, n), and stays inside a bracket that shrinks (else it
    halves it, as do all steps after NEWTON_STEPS, so that every source comes to its target or to the end of its
    bracket's precision). Steps are cut by checkpoints. All sums are of whole numbers, so reruns agree.
    """
    s, t = F.col("source_size").cast("double"), F.col("target")
    mean = s / F.col("docs")
    full = (F.col("source_size") == 0) | (t >= most * s)
    state = cut(goals.withColumn("tilt", F.when(full, 50.0 * mean).otherwise(0.0)).withColumn("lo", F.when(s > 0, -F.log(s / F.greatest(t, F.lit(1e-9))) * mean - 1).otherwise(0.0)).withColumn("hi", F.log(F.lit(float(most))) * mean + 1).withColumn("done", full))
    for number in count():
        open_ = state.where("not done")
        z, rate = _rate(F.col("size"), F.col("docs"), s, F.col("tilt"), most)
        x = classes.join(open_, "key").withColumn("z", z).withColumn("rate", rate).withColumn("words", (F.col("n") * F.col("size")).cast("decimal(20,0)"))
        slope = F.when(F.col("rate") < most * UNIT, F.round(F.col("z") * F.col("rate")).cast("long")).otherwise(F.lit(0))
        sums = x.groupBy("key").agg((F.sum(F.col("words") * F.col("rate").cast("decimal(12,0)")) / UNIT).cast("double").alias("f"), (F.sum(F.col("words") * slope.cast("decimal(17,0)")) / UNIT).cast("double").alias("g"))
        y = state.join(sums, "key", "left")
        low = F.col("f") < t
        lo, hi = F.when(low, F.col("tilt")).otherwise(F.col("lo")), F.when(~low, F.col("tilt")).otherwise(F.col("hi"))
        y = y.select("key", "source", "source_size", "docs", "target", "tilt", "f", "g", "done", F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"))
        newton = F.when((F.col("g") > 0) & F.lit(number < NEWTON_STEPS), F.col("tilt") - (F.col("f") - t) / F.col("g"))
        half = (F.col("lo") + F.col("hi")) / 2
        reached = F.col("done") | (F.abs(F.col("f") - t) <= TOLERANCE * t) | (F.col("hi") - F.col("lo") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("hi"), F.abs("lo")))
        step = F.when(reached, F.col("tilt")).when(newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(half)
        state = cut(y.select("key", "source", "source_size", "docs", "target", step.alias("tilt"), "lo", "hi", reached.alias("done")))
        if not state.where("not done").limit(1).count():
            return state


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (a checkpoint, with the number `place` of the task that wrote each) with `lot`: 0, but for rows that are repeated
    more than RANKED times the number of their lot of RANKED. They are counted by place, and numbered from there on, so
    that no task numbers all repeats; which lots there are depends on their count alone, so reruns agree."""
    often = cut(rows.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > RANKED).select("h"))
    if not often.limit(1).count():
        return rows.withColumn("lot", F.lit(0).cast("long"))
    counts = rows.join(sent_if_small(often, ROW_BYTES), "h", "left_semi").groupBy("h", "place").agg(F.count("*").alias("m"))
    before = Window.partitionBy("h").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("h", "place", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first")))
    met = rows.join(sent_if_small(starts, ROW_BYTES), ["h", "place"], "left")
    number = F.row_number().over(Window.partitionBy("h", "place").orderBy("h"))
    hot = met.where("first is not null").withColumn("lot", F.floor((F.col("first") + number - 1) / RANKED))
    return hot.drop("first").unionByName(met.where("first is null").withColumn("lot", F.lit(0).cast("long")).drop("first"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """How often each document enters a mix whose sources have target shares of all words.

    Entropy balancing: a document's rate is exp(tilt of its source * its size), at most `most`. Rates become copies by
    systematic rounding over the documents of a source in the order of their sizes, then of a hash of id and text: the
    running sum of rates, rounded, less the same before the document. Of 32 starts of the running sum, each source takes
    the one whose words come nearest its target; no document has more than `most` copies. The running sum is that of the (source, size)
    table, plus that of hashed parts of a class of equal sizes, plus a rank within a part of about 512 rows: no task
    gets a whole source or a whole group of copies.

    Returns id, source, size, source_size, target, copies, taken and the columns of carry. Null text (size 0) and null id are allowed; null source is a source of its own, last in order. Sources without words have target 0. Repeated rows
    count as documents. An empty table gives no rows.
    """
    carry = carry or {}
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col, F.lit(11)).alias("h"), F.spark_partition_id().alias("place"), *[c.alias(f"carry_{k}") for k, c in carry.items()]))
    classes = cut(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    sources = classes.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    state = tilts(classes.drop("source"), cut(targets(sources, weights, most)), most)
    _, rate = _rate(F.col("size"), F.col("docs"), F.col("source_size").cast("double"), F.col("tilt"), most)
    rated = classes.drop("source").join(state, "key").select("key", "size", "n", "source_size", "target", F.when(F.col("source_size") == 0, 0).otherwise(rate).alias("rate"))
    smaller = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = cut(rated.select("*", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0)).alias("before"), F.ceil(F.col("n") / RANKED).alias("parts")))
    tried = rated.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(UNIT - 1), F.lit(UNIT // PHASES)))).groupBy("key", "start").agg(
        F.sum(F.expr(f"size * ((before + n * rate + start) div {UNIT} - (before + start) div {UNIT})")).alias("taken"), F.first("target").alias("goal")
    )
    starts = tried.groupBy("key").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("goal")).alias("miss"), "start"))["start"].alias("start"))
    rated = cut(rated.join(starts, "key"))
    near = _numbered(rows).join(sent_if_small(rated.drop("n"), ROW_BYTES), ["key", "size"])
    near = near.withColumn("part", F.when(F.col("lot") == 0, F.pmod("h", "parts")).otherwise(F.pmod(F.xxhash64("h", "lot"), "parts")))
    # dealt by the part too: a size that most documents have is no hot spot
    dealt = near.repartition("key", "size", "part")
    parts = near.groupBy("key", "size", "part").agg(F.count("*").alias("m"))
    lower = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select("key", "size", "part", F.coalesce(F.sum("m").over(lower), F.lit(0)).alias("skipped")))
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "id"))
    placed = dealt.withColumn("rank", rank).join(sent_if_small(parts, ROW_BYTES), ["key", "size", "part"])
    upto = lambda k: F.expr(f"(before + (skipped + rank - {k}) * rate + start) div {UNIT}")
    copies = (upto(0) - upto(1)).cast("long")
    return placed.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"carry_{k}").alias(k) for k in carry])
