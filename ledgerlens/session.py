"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what a step has shuffled goes when the step ends, not when the driver collects garbage; a frame that is run again
    # makes it again
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app_name: str = "ledgerlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's runtime settings; `master` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(spark: SparkSession, tasks: int) -> None:
    """At least `tasks` tasks where a large table is read or shuffled; adaptive execution joins those with few rows.

    Both settings are counts of the session's, raised for tables of many rows and lowered again for small ones.
    """
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(shuffled, tasks))
    spark.conf.set("spark.sql.files.minPartitionNum", tasks)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in spark.checkpoint.dir.

    Only a master whose tasks all run in the driver's process may fall back to a folder of its own: elsewhere a
    machine-local path would lose data with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder and go on from there, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_and_read(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """As `materialize`, but columnar: later steps prune columns and push filters into the written table."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
