"""Incremental ingest: watermarked dedup of a stream, appended only where the key is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import etl


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; works on streams and on batches."""
    df = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def idempotent_sink(spark: SparkSession, path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows whose key the table at path lacks are appended, so a batch may run twice."""

    def write(batch: DataFrame, _: int) -> None:
        try:
            known = spark.read.parquet(path).select(*keys)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only the first batch has no table yet
                raise
            known = batch.select(*keys).limit(0)
        etl.append_new(known, batch, keys).write.mode("append").parquet(path)

    return write


def windowed_totals(events: DataFrame, ts: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type."""
    df = events.withColumn(ts, F.col(ts).cast("timestamp"))
    df = df.withWatermark(ts, late) if df.isStreaming else df
    return df.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("inicio"), "event_type", "n", "total")
