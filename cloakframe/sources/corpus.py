"""Reading corpora and writing masked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators.policy import language_of
from cloakframe.session import COMPACT


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when the input has fewer splits than there are cores.

    Text work costs far more than reading, so a small table in one file is redistributed by key;
    a large one already comes in many splits and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of parts.

    The path is a pattern: Spark takes a plain path for the root of a partitioned table, which a single file can't be.
    """
    schema = read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (doc_id, path, language, text); other file types are left out.

    The id is a hash of the path, so it stays the same from run to run.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return (
        files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        .withColumn("language", language_of(F.col("path")))
        .where(F.col("language").isNotNull())
        .select(F.xxhash64("path").alias("doc_id"), "path", "language", "text")
    )


def write_masked(df: DataFrame, path: str, source: str, id_col: str = "doc_id") -> None:
    """Write to a new place, with the id of the source row; an existing table is never replaced."""
    df.withColumn("source", F.lit(source)).withColumnRenamed(id_col, "source_doc_id").write.mode(
        "errorifexists"
    ).parquet(path, compression=COMPACT)
