"""The audit log on disk: JSON lines, one folder per day, append only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators.audit import ENTRY_SCHEMA, recent


def append_entries(entries: DataFrame, path: str) -> None:
    entries.withColumn("log_date", F.to_date("timestamp")).write.mode("append").partitionBy("log_date").json(path)


def parsed(lines: DataFrame) -> DataFrame:
    """Text lines as entries; ``_corrupt_record`` holds the line where it is no JSON object."""
    schema = f"{ENTRY_SCHEMA}, _corrupt_record string"
    entry = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(F.trim("value") != "").select(entry.alias("e"), *rest).select("e.*", *rest)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed entries; ``log_date`` prunes folders."""
    return parsed(spark.read.text(path)).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_malformed(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path)).where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def log_dates(spark: SparkSession, path: str) -> list[str]:
    """The days of a log, newest first, from the names of its files; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    day = F.regexp_extract("path", "/log_date=([0-9]{4}-[0-9]{2}-[0-9]{2})/", 1)
    return [r["day"] for r in files.select(day.alias("day")).where("day <> ''").distinct().orderBy(F.desc("day")).collect()]


def recent_entries(spark: SparkSession, path: str, count: int, tie_break: str | None = None) -> DataFrame:
    """The newest ``count`` entries of a log: its newest days are read until they hold so many.

    The days taken at once double, so a log of few entries per day takes few rounds. Entries without a time stand in no day
    and are no newest ones.
    """
    days = log_dates(spark, path)
    taken, step = [], 1
    while days:
        taken, days, step = taken + days[:step], days[step:], 2 * step
        if read_days(spark, path, taken).count() >= count:
            break
    return recent(read_days(spark, path, taken), count, tie_break=tie_break)


def read_days(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    """Well-formed entries of some days; only their folders are listed and read."""
    if not days:
        return spark.createDataFrame([], f"{ENTRY_SCHEMA}, log_date date")
    lines = spark.read.option("basePath", path).text([f"{path}/log_date={d}" for d in days])
    return parsed(lines).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
