"""Reading the tables, row identity and small helpers shared by the operators."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import stipendia
from stipendia import session

#: Stands in for a null id, so that it sorts first and joins like any other.
NULL_ID = -(2**63)


_shipped: set[str] = set()
#: Bytes in a batch that goes to a Python worker, unless the session has chosen.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package; Spark hands the archive to every executor."""
    context = spark.sparkContext
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(stipendia.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stipendia-"), "stipendia_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table after writing it to the shared folder; a lost executor costs a re-read."""
    spark, schema = df.sparkSession, df.schema
    path = session.scratch_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    del df
    free(spark)
    return spark.read.schema(schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def identified(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns _id (null: NULL_ID), _sum (a hash of the text) and _text (null: empty).

    Rows with equal _id and _sum are the same document, so results for one serve all of them.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(body).alias("_sum"), body.alias("_text"))


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns under safe names c0, c1, ... and the key _id, _sum; undo with `restored`."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    body = F.coalesce(plain[f"c{docs.columns.index(text)}"].cast("string"), F.lit(""))
    number = plain[f"c{docs.columns.index(id_column)}"].cast("long")
    return plain.select("*", F.coalesce(number, F.lit(NULL_ID)).alias("_id"),
                        F.xxhash64(body).alias("_sum"))


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that `docs` has, under their own names."""
    return found.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def given_id(column: str = "_id") -> Column:
    """The id as it was given."""
    return F.when(F.col(column) != NULL_ID, F.col(column))
