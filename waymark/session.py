"""Session settings that the engine's results rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave master and partitions to the submit command."""
    b = SparkSession.builder.appName("waymark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all machines share (spark.checkpoint.dir), so that what follows doesn't
    compute it again. Only a session on a single machine may leave the folder unset."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="waymark-"))
    return df.checkpoint()
