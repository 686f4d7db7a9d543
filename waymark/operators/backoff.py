"""Backoff of targets from their probe log."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import backoff_interval


def backoff_state(probes: DataFrame, strategy: str = "exponential", keys: tuple[str, ...] = ("ident_hash_hex",)) -> DataFrame:
    """(keys, consecutive_failures, backoff_until, last_probed_at) after a probe log.

    The failures in a row are those after the last success. Both are small states that start where the log lies and are
    folded by key: first the last success and the last probe, then how many failures are later. The log itself is joined
    to the first, so no task holds the whole log of a target, however hot it is.
    """
    k, own = list(keys), [f"_{c}" for c in keys]
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(k, own, strict=True)])
    log = probes.select(*k, "probed_at", "reachable")
    last = log.groupBy(*k).agg(F.max(F.when(F.col("reachable") == 1, F.col("probed_at"))).alias("ok"), F.max("probed_at").alias("last_probed_at"))
    late = log.where("reachable = 0").join(last.toDF(*own, "ok", "last"), same).where("ok is null or probed_at > ok")
    failures = late.groupBy(*own).agg(F.count("*").cast("int").alias("n"))
    state = last.join(failures, same, "left").select(*k, F.coalesce("n", F.lit(0)).alias("consecutive_failures"), "last_probed_at")
    until = F.when(F.col("consecutive_failures") == 0, F.lit(0.0)).otherwise(F.col("last_probed_at") + backoff_interval(F.col("consecutive_failures"), strategy))
    return state.select(*k, "consecutive_failures", until.alias("backoff_until"), "last_probed_at")


def apply_backoff(targets: DataFrame, probes: DataFrame, strategy: str = "exponential") -> DataFrame:
    """Targets after a batch of probes, on top of the failures they had: by hash, or by name without one."""
    own = F.coalesce(F.nullif("ident_hash_hex", F.lit("")), "i2p_dns_name")
    keyed = probes.withColumn("_key", own)
    batch = backoff_state(keyed, strategy, ("_key",)).withColumnRenamed("consecutive_failures", "_new").withColumnRenamed("last_probed_at", "_at").drop("backoff_until")
    succeeded = keyed.groupBy("_key").agg(F.max("reachable").alias("_ok"))
    x = targets.withColumn("_key", own).join(batch, "_key", "left").join(succeeded, "_key", "left")
    total = F.when(F.col("_ok") == 1, F.col("_new")).otherwise(F.col("consecutive_failures") + F.col("_new"))
    x = x.withColumn("_total", total)
    seen = F.col("_new").isNotNull()
    return x.withColumns({
        "consecutive_failures": F.when(seen, F.col("_total")).otherwise(F.col("consecutive_failures")),
        "backoff_until": F.when(seen & (F.col("_total") == 0), F.lit(0.0)).when(seen, F.col("_at") + backoff_interval(F.col("_total"), strategy)).otherwise(F.col("backoff_until")),
        "last_probed_at": F.coalesce("_at", "last_probed_at"),
    }).select(*targets.columns)
