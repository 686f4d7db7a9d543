"""Pages that need review: what marks them off from pages that are understood, rules from such marks, and probing again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import once
from ..plans.address_book import address_book
from ..session import cut
from ..sources.fetch import Fetcher, fetch
from .extractors import Registry, RuleExtractor, detected_type
from .merge import clear_reviews, upsert_discoveries
from .probe import probe
from .relational import flagged
from .store import Store

#: Characters of a mark, the flagged pages that must have it, the share of its pages that must be flagged, marks that are weighed
#: against each other, and rules that come out.
SHORTEST, LONGEST = 4, 60
SUPPORT, PRECISION = 3, 1.0
CANDIDATES, RULES = 256, 8
#: Bytes of a hash of a mark in a broadcast, and of all that may be sent so; beyond it a bitmap is sent.
HASH_BYTES, BROADCAST_BYTES = 32, 16 << 20
#: A bitmap of hashes of marks has so many rows, as a power of two, of 64 words of 64 bits: 16 MB at most, whatever the marks.
ROW_BITS = 15


def words(body: Column) -> Column:
    """A body in lower case, cut at white space."""
    return F.filter(F.split(F.lower(body), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def marks(body: Column) -> Column:
    """Distinct stretches of one and two words of a body that may be marks."""

    def own(w: Column) -> Column:
        pairs = F.transform(w, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
        return F.array_distinct(F.filter(F.concat(w, pairs), lambda m: F.length(m).between(SHORTEST, LONGEST)))

    return once(words(body), own)


def held(text: Column, listed: list[str]) -> Column:
    """The listed strings that a text holds. Python searches texts several times as fast as an array of `contains`."""

    @F.pandas_udf("array<string>")
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [m for m in listed if m in t] if t else [])

    return search(text)


def _in_bitmap(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (mark) whose mark is among those found, and a few others, by a broadcast bitmap of hashes."""
    hashed = lambda rows: rows.withColumn("h", F.xxhash64("mark")).withColumn("slot", F.col("h").bitwiseAND((1 << ROW_BITS) - 1))
    word, bit = (F.shiftright("h", n).bitwiseAND(63).cast("int") for n in (ROW_BITS, ROW_BITS + 6))
    bits = hashed(found).groupBy("slot", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(h, {ROW_BITS + 6}) & 63 as int))")).alias("bits"))
    bits = bits.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    known = F.broadcast(bits.select("slot", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("words")))
    return hashed(rows).join(known, "slot").where(F.getbit(F.get("words", word), bit) == 1).select("mark")


def contrast(pages: DataFrame, support: int = SUPPORT, precision: float = PRECISION) -> DataFrame:
    """Marks of pages (id, body, flagged): mark, n_flagged, n_claimed, precision.

    Each page counts once for a mark it has; sums start where the pages lie, so a mark that all pages have is no hot key.
    Kept are marks of at least `support` flagged pages whose share of flagged ones is `precision` or more. Only the marks
    of flagged pages that have the support are looked for in the others, by a broadcast of their hashes or, beyond
    BROADCAST_BYTES, of a bitmap of a fixed size, so that all marks of the others are never summed up. Null bodies have no marks; a null flag counts
    as not flagged.
    """
    flag = F.coalesce("flagged", F.lit(False))
    of = lambda rows: rows.select(F.explode(marks(F.col("body"))).alias("mark"))
    found = cut(of(pages.where(flag)).groupBy("mark").agg(F.count("*").alias("n_flagged")).where(F.col("n_flagged") >= support))
    others = of(pages.where(~flag))
    if found.count() * HASH_BYTES <= BROADCAST_BYTES:
        known = F.broadcast(found.select(F.xxhash64("mark").alias("h")).distinct())
        others = others.join(known, F.xxhash64("mark") == F.col("h"), "left_semi")  # a few others pass, and go below
    else:
        others = _in_bitmap(others, found)
    others = others.groupBy("mark").agg(F.count("*").alias("n"))
    n = found.join(others, "mark", "left").select("mark", "n_flagged", F.coalesce("n", F.lit(0)).alias("n_claimed"))
    share = F.col("n_flagged") / (F.col("n_flagged") + F.col("n_claimed"))
    return n.withColumn("precision", share).where(F.col("precision") >= precision)


def mine_rules(pages: DataFrame, support: int = SUPPORT, precision: float = PRECISION, most: int = RULES, candidates: int = CANDIDATES) -> DataFrame:
    """Rules that tell flagged pages (id, body, flagged) from the others: rank, mark, kind, support, precision, covered.

    The `candidates` marks with the widest support are counted again as plain substrings, as an extractor will look for
    them, since a word of a claimed page may hold one. Then the mark that covers most pages without a rule becomes the
    next rule, until none covers `support` of them or there are `most`; ties go to the first by code point. kind is the
    type that an inspection sees in most covered pages. Only candidates, one row each, reach the driver.
    """
    spark = pages.sparkSession
    schema = "rank int, mark string, kind string, support long, precision double, covered long"
    top = [r.mark for r in contrast(pages, support, precision).orderBy(F.desc("n_flagged"), "mark").limit(candidates).collect()]
    if not top:
        return spark.createDataFrame([], schema)
    low = F.array_join(words(F.col("body")), " ")
    own = pages.select(F.coalesce("flagged", F.lit(False)).alias("flagged"), "body", held(low, top).alias("hits"))
    # bodies are kept for the kinds of flagged pages
    own = cut(own.where(F.size("hits") > 0).select("flagged", F.when(F.col("flagged"), F.col("body")).alias("body"), "hits"))
    judged = own.select("flagged", F.explode("hits").alias("mark")).groupBy("mark").agg(F.count_if("flagged").alias("support"), (F.count_if("flagged") / F.count("*")).alias("precision"))
    good = {r.mark: r for r in judged.where((F.col("support") >= support) & (F.col("precision") >= precision)).collect()}
    found, chosen = [], []
    left = own.where("flagged").select("body", F.filter("hits", lambda m: m.isin(list(good))).alias("hits")).where(F.size("hits") > 0)
    while len(found) < most and good:
        best = left.select(F.explode("hits").alias("mark")).groupBy("mark").agg(F.count("*").alias("covered")).where(F.col("covered") >= support).orderBy(F.desc("covered"), "mark").first()
        if best is None:
            break
        # an inspection takes far longer than a search, so only pages that the rule covers get one
        kinds = left.where(F.array_contains("hits", best.mark)).select(detected_type(F.coalesce("body", F.lit("")), F.lit("")).alias("kind"))
        kind = kinds.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("kind")).first().kind
        chosen.append(best.mark)
        found.append((len(found) + 1, best.mark, kind, good[best.mark].support, good[best.mark].precision, best.covered))
        left = left.where(~F.arrays_overlap("hits", F.array(*map(F.lit, chosen))))
    return spark.createDataFrame(found, schema)


def extractors_of(rules: DataFrame) -> Registry:
    """A registry of the rules; at most RULES rows or as many as were mined reach the driver."""
    return Registry([RuleExtractor(f"mined {r.rank}", r.kind if r.kind != "unknown" else "mined", [r.mark], 50 + r.rank, f"Mark: {r.mark}") for r in rules.orderBy("rank").collect()])


def reprobe(store: Store, fetcher: Fetcher, now: float, limit: int | None = None, delay: float = 0.0, registry: Registry | None = None) -> dict[str, int]:
    """Probes the flagged destinations again, in the order of the review list, each hash once.

    The mark goes from those that answer with a content type and stays on all others. What was found and the cleared marks become visible together. Returns how
    many were probed, answered, failed and cleared, counted in the pass that writes the verdicts.
    """
    book = address_book(store.read("discoveries"), store.read("routers"), store.read("leasesets"))
    queue = flagged(book).select("ident_hash_hex", F.coalesce("dns_name", F.lit("")).alias("i2p_dns_name"))
    queue = queue if limit is None else queue.limit(limit)
    key = F.coalesce(F.nullif("ident_hash_hex", F.lit("")), "i2p_dns_name")
    todo = cut(queue.withColumn("b32_addr", F.lit("")).withColumn("_key", key).dropDuplicates(["_key"]).drop("_key"))
    seen = Observation()
    with store.commit() as c:
        c.write("probes", probe(todo, fetcher, now, delay, registry=registry))
        new = c.read("probes")
        verdicts = new.groupBy(key.alias("_key")).agg(F.max("ident_hash_hex").alias("ident_hash_hex"), F.max("reachable").alias("up"), F.bool_or((F.col("reachable") == 1) & (F.coalesce("content_type", F.lit("")) != "")).alias("done"))
        verdicts = cut(verdicts.observe(seen, F.count("*").alias("probed"), F.coalesce(F.sum("up"), F.lit(0)).alias("answered"), F.count_if(F.col("up") == 0).alias("failed"), F.count_if("done").alias("cleared")))
        c.merge("discoveries", new, upsert_discoveries)
        c.merge("discoveries", new, lambda stored, _: clear_reviews(stored, verdicts.where("done and ident_hash_hex <> ''")))
    return seen.get


def bodies(store: Store, fetcher: Fetcher, delay: float = 0.0) -> DataFrame:
    """(id, body, flagged) of the destinations that were ever reached or are flagged: their pages as of now."""
    book = address_book(store.read("discoveries"), store.read("routers"), store.read("leasesets"))
    host = F.coalesce(F.nullif("dns_name", F.lit("")), F.nullif("b32_addr", F.lit("")))
    sites = book.where(((F.col("reachable") == 1) | (F.col("needs_review") == 1)) & host.isNotNull()).select(host.alias("id"), (F.col("needs_review") == 1).alias("flagged"))
    sites = sites.groupBy("id").agg(F.bool_or("flagged").alias("flagged")).withColumn("url", F.concat(F.lit("http://"), "id", F.lit("/")))
    got = fetch(sites.select("url"), fetcher, delay).where((F.col("status") >= 200) & (F.col("status") < 400))
    return sites.join(got, "url").select("id", F.decode("body", "UTF-8").alias("body"), "flagged")


def heal(store: Store, fetcher: Fetcher, now: float, rounds: int = 5, limit: int | None = None, delay: float = 0.0, **mining) -> list[dict]:
    """Mines rules, probes the flagged destinations with them, and clears the marks, until a round clears nothing.

    Returns a row a round: the counts of reprobe, and the rules with their support and precision.
    """
    out: list[dict] = []
    while len(out) < rounds:
        rules = cut(mine_rules(cut(bodies(store, fetcher, delay)), **mining))
        counts = reprobe(store, fetcher, now + len(out), limit, delay, extractors_of(rules))
        out.append(counts | {"rules": [r.asDict() for r in rules.orderBy("rank").collect()]})
        if not counts["cleared"]:
            break
    return out
