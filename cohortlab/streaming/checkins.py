"""Symptom check-ins as a stream: dedupe, windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def clean(events: DataFrame, ts: str = "ts", key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Drop repeated entries; rows later than the delay are dropped by the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def window_averages(events: DataFrame, by: list[str], ts: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Count and mean per tumbling (or sliding) window; append mode."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(span.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "mean_value")


def sessions(events: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """Stretches of entries no further apart than the gap; append mode."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available now and append it to a Parquet folder."""
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
