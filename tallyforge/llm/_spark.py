"""Helpers on sessions and tables that the operators share."""

from __future__ import annotations

import gc
import itertools
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES_A_RELEASE = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the setting is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_tables = itertools.count(1)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder. Every few tables, shuffle files of the plans before
    are let go, as a driver that makes little garbage would keep them to the end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_tables) % TABLES_A_RELEASE == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes a table made by written() that is not needed any longer."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        path.getFileSystem(conf).delete(path, True)


def keyed(df: DataFrame, name: str = "_row") -> DataFrame:
    """df, written, with a number of its own for each row: decisions on repeated and null ids go by it."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, n_bytes: int, part_bytes: int = 24 << 20) -> int:
    """Number of partitions of about part_bytes each; the session's setting at least."""
    return max(parallelism(spark), -(-int(n_bytes or 0) // part_bytes))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows and bytes: a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds name: the place (from 0) in this order of rows whose keys are distinct. Ranges of keys are
    counted by themselves; only one row for each range is summed without a key."""
    ranged = written(df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), name)
    before = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are done: its cleaner acts on collected garbage, and what
    Python has dropped reaches the JVM a moment later."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()
