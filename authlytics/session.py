"""Spark session and shared-storage helpers.

On a cluster the session is created by the platform; ``get_spark`` only fills in
settings that are unset. Scratch data (lineage cuts, model tables written during
a run) always goes below the session's ``spark.checkpoint.dir`` so that it sits on
shared storage and survives executor loss. A private temporary folder is created
only when the session has none, which is the local/test case.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a plan in this package relies on. ``get_spark`` gives them to a session it
# builds; ``apply_defaults`` only fills in what a given session leaves unset (and pins
# the time zone).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # exchanges begin with many small partitions, which AQE joins to tasks of a bounded size: a
    # task's sorts don't grow with the table. A task that reads 37 MB (compressed) held 1.9 GB in
    # the sorts of the window features; Spark's own 64 MB would let it hold over 3 GB
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a window partitioned by (ip, bucket, user) may reuse a hash partitioning on
    # (ip, bucket): one exchange serves every window of a side
    "spark.sql.requireAllClusterKeysForDistribution": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "authlytics", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_defaults(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL settings the plans need, without overriding any
    value a cluster profile has set explicitly (timezone is always pinned)."""
    for k, v in DEFAULT_CONF.items():
        if k == "spark.sql.session.timeZone":
            spark.conf.set(k, v)
            continue
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static conf on some deployments
            pass


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and scratch tables.

    Uses ``spark.checkpoint.dir`` (or the SparkContext checkpoint dir) of the
    session. Only a local run without either gets a temporary folder; on a
    cluster, where executors wouldn't see it, that is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="authlytics-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    sep = "" if root.endswith("/") else "/"
    return f"{root}{sep}{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never localCheckpoint): the data is written to the
    shared checkpoint folder so a lost executor does not force a recompute of
    the upstream plan."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
