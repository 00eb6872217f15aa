"""Session settings, durable intermediate results and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Removing repeated rows keeps the different rows of a task in memory before the shuffle, and
    # spills what doesn't fit. Small tasks, of scans and after shuffles, have room for theirs.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # The JVM does not compile methods above this size. Long rule chains would be interpreted
    # inside whole-stage code; below the limit Spark splits them into small compiled methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def build(app: str = "stipendia", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the library is designed for; `extra` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Put settings that nobody has chosen on a session that somebody else built."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local-mode session, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    named = tempfile.mkdtemp(prefix="stipendia-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether files that an earlier query wrote are still there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a stored table, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str, *partitions: str) -> tuple[str, StructType]:
    """Write a table once to the shared folder; what to read it back with.

    Later jobs start from the files: they prune columns and partitions, and a lost executor
    costs a re-read only. Tasks write their own rows of each partition, as partitions are few (splits,
    years): a shuffle to have fewer files would cost more than they do.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partitions).option("compression", "zstd").parquet(path)
    return path, df.schema


def written(df: DataFrame, name: str) -> DataFrame:
    """A table after writing it: its lineage ends at the files, and its size is known."""
    path, schema = staged(df, name)
    return df.sparkSession.read.schema(schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs a re-read only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
