"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "regimen",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and UTC as session time zone.

    What spark-submit or the defaults file have set stays as it is; the values
    here fill what is unset, the number of partitions only in local mode.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if "PYSPARK_GATEWAY_PORT" not in os.environ:             # not under spark-submit
        builder = (builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                   # checkpoints of split plans are removed once their DataFrames are gone
                   .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
                   .config("spark.driver.memory", os.environ.get("REGIMEN_DRIVER_MEMORY", "8g")))
    spark = builder.getOrCreate()
    wanted = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
    }
    if spark.sparkContext.master.split("[")[0] == "local":
        wanted["spark.sql.shuffle.partitions"] = os.environ.get("REGIMEN_SHUFFLE_PARTITIONS", "8")
    submitted = spark.sparkContext.getConf()
    for key, value in wanted.items():
        if not submitted.contains(key):
            spark.conf.set(key, value)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.sparkContext.setLogLevel("FATAL")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Set only when the session has none (local tests); on a cluster the
    configured shared folder is used as is.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster "
                               "(checkpoints and model tables are written there)")
        current = tempfile.mkdtemp(prefix="regimen-ckpt-", dir="/tmp")   # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current
