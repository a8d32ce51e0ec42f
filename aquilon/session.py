"""Session settings that the engine relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "aquilon", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    b = b.master(master) if master else b
    return (b.config("spark.sql.shuffle.partitions", shuffle_partitions) if shuffle_partitions else b).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a session of one process without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="aquilon-")


def by_frame(df: DataFrame) -> DataFrame:
    """df dealt by (trajectory, frame). Joins and groups within frames then need no further exchange. The number of
    parts is explicit, so that adaptive coalescing (which looks at bytes, not at pairs) leaves it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "trajectory_id", "snapshot")
