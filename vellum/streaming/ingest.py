"""Streams: new files once each, corrections appended as they come, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys older than the watermark are forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Counts by event-time window; a window is given out once the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def append_corrections(stream: DataFrame, table: str, checkpoint: str):
    """Appends each micro-batch to a Parquet table; a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
