"""Streaming forms: upserts, backoff, reachability by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import BACKOFF
from ..operators.merge import fold_probes, upsert_discoveries
from ..operators.store import Store

BACKOFF_STATE = "ident_hash_hex string, consecutive_failures int, backoff_until double, last_probed_at double"


def wait(failures: int, strategy: str = "exponential") -> float:
    if failures <= 0:
        return 0.0
    return float(300 * failures if strategy == "fixed" else BACKOFF[min(failures, len(BACKOFF)) - 1])


def stream_backoff(probes: DataFrame, strategy: str = "exponential") -> DataFrame:
    """Backoff of each hash, updated by each batch of probes (ident_hash_hex, reachable, probed_at)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, at = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values("probed_at")
        for up, t in zip(rows["reachable"], rows["probed_at"], strict=True):
            failures, at = (0 if up else failures + 1), max(at, float(t))
        state.update((int(failures), float(at)))
        yield pd.DataFrame([(key[0], failures, at + wait(failures, strategy) if failures else 0.0, at)], columns=["ident_hash_hex", "consecutive_failures", "backoff_until", "last_probed_at"])

    return probes.select("ident_hash_hex", "reachable", "probed_at").groupBy("ident_hash_hex").applyInPandasWithState(step, BACKOFF_STATE, "failures int, last double", "update", GroupStateTimeout.NoTimeout)


def stream_series(probes: DataFrame, bucket: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Probes by time window; rows that come later than the watermark are left out of closed windows."""
    timed = probes.withColumn("ts", F.timestamp_seconds("probed_at")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", bucket)).agg(F.count("*").alias("total_probes"), F.count_if(F.col("reachable") == 1).alias("reachable"))
    return out.select(F.col("window.start").alias("ts_utc"), "total_probes", "reachable", (F.col("total_probes") - F.col("reachable")).alias("unreachable"), F.bround(100.0 * F.col("reachable") / F.col("total_probes"), 0).cast("long").alias("pct"))


def stream_upserts(probes: DataFrame, store: Store, checkpoint: str, **trigger):
    """A query that merges each batch of probes into the stored discoveries.

    A batch rewrites only the buckets that its keys fall into. Columns that the probes lack keep their stored values. The
    version that holds a batch also holds its number, so a batch that is run again after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # its keys are read before it is merged
        try:
            store.merge("discoveries", held, upsert_discoveries, checkpoint, number)
        finally:
            held.unpersist()

    return probes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["fold_probes", "stream_backoff", "stream_series", "stream_upserts", "wait"]
