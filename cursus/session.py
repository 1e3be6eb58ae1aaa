"""Session helpers: local sessions for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cursus",
                  driver_memory: str = "16g", event_log_dir: str | None = None) -> SparkSession:
    """A local session configured the way the reports expect (AQE on, UI off, UTC)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
         # Spark's own listing starts a task a folder or file up to this many; the default is 10,000.
         .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # Plans are built by many small DataFrame calls; skipping the per-call
         # Python call-site capture (error-message context only) saves several
         # driver round trips per call.
         .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Does the session run in one process? (A local cluster has executors of its own.)"""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, name: str = "") -> str:
    """Folder for checkpoints and materialised tables, shared by driver and executors.

    The one named in ``spark.checkpoint.dir``, or else the session's checkpoint
    folder. A local session without either gets a temporary folder; elsewhere
    that is an error, because executors would write to their own disks.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cursus-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}" if name else base
