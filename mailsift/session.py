"""Session helpers: a tuned local session for tests and benches, and the shared scratch folder.

On a cluster the session comes from the caller; nothing here overrides settings that are
already set. ``scratch_dir`` reads ``spark.checkpoint.dir`` and only invents a local folder
when the session has none (tests, local runs).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a local session starts with. On a cluster the same keys should be sized to the
# data: shuffle partitions ~ (shuffled bytes / 128 MB), maxPartitionBytes 128-256 MB.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.driver.memory": "8g",
}


def get_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "mailsift",
                extra: dict | None = None) -> SparkSession:
    """Local session used by tests and ``bench.py``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                       **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir``. Only a local session may go without it: it gets a fresh
    folder under /tmp. On a cluster executors would write to their own disks there, so a
    missing setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A never-reused sub folder of the scratch dir (jobs never overwrite what they read)."""
    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_utc(spark: SparkSession) -> None:
    """Date criteria are defined in UTC; test timestamps are TIMESTAMP_NTZ wall clock."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def materialize(df, name: str):
    """Write an intermediate that is read several times as Parquet in the shared scratch
    folder and read it back: computed once, lineage cut, survives executor loss."""
    path = new_scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
