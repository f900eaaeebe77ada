"""Session helpers.  Nothing here overrides what a cluster already configured."""

from __future__ import annotations

import os
import re
import tempfile
import threading

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "quantloom") -> SparkSession:
    """Session for tests and the benchmark.  On a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's checkpoint folder.  A scratch one only with a local master, where all is one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))


#: Spark's own switch: the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PLANNING = threading.Lock()


def checkpointed(df):
    """Reliable checkpoint: survives the loss of an executor, unlike a cached or local copy.

    Nothing reads the shuffle files of a checkpoint again, so they go with it: those of many rounds would otherwise lie beside each other until the driver's next collection.
    The switch counts while the plan is made and is put back; `df` itself keeps its files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _PLANNING:
        before = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
        try:
            once = df.select("*")
        finally:
            spark.conf.set(CLEANUP, before)
    return once.checkpoint(eager=True)
