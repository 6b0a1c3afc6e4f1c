"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library wants; a cluster may set its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hot keys are split even where that costs one more shuffle behind the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app_name: str = "assayworks", cores: str | int = "*",
                  shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder for tables a job writes and reads back.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``. A session on one
    machine without that setting gets a folder of its own, which the setting then names.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="assayworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/assayworks/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the workspace and read it back.

    What follows starts from the files: a lost executor costs re-reading its part instead of
    re-running everything before, and tasks carry no long history. The rows are rebalanced on
    the way, so parts are neither tiny nor lopsided.
    """
    path = workspace(df.sparkSession, label)
    df.hint("rebalance").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    files = df.inputFiles()
    if not files:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if "/assayworks/" in folder.toString():
        folder.getFileSystem(conf).delete(folder, True)
