"""Streams over the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.sources.audit_log import parsed


def read_audit_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parsed(reader.text(path))


def ingest_audit(entries: DataFrame, sink: str, malformed_sink: str, checkpoint: str) -> list[StreamingQuery]:
    """Well-formed entries into dated folders, malformed lines aside; both sinks are exactly-once."""
    good = entries.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = entries.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return [
        good.withColumn("log_date", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .partitionBy("log_date")
        .option("path", sink)
        .option("checkpointLocation", f"{checkpoint}/good")
        .trigger(availableNow=True)
        .start(),
        bad.writeStream.format("text")
        .option("path", malformed_sink)
        .option("checkpointLocation", f"{checkpoint}/bad")
        .trigger(availableNow=True)
        .start(),
    ]


def live_totals(entries: DataFrame, time_col: str, action_col: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Entries per window and action; entries later than the watermark are dropped."""
    return (
        entries.withWatermark(time_col, late)
        .groupBy(F.window(time_col, width).alias("w"), F.col(action_col).alias("action"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "action", "n")
    )
