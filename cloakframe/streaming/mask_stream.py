"""Masking of a stream of documents with one growing dictionary.

The dictionary is kept as a *snapshot* and the *deltas* of the batches behind it:

    delta/batch_id=N     entries that batch N added          alike/batch_id=N    its words that look like tokens
    snapshot/upto=M      all entries of batches up to M      alike_upto/upto=M   all such words
    manifest/batch_id=N  one row: the snapshot that is current behind batch N

Every ``compact_every`` batches the snapshot and its deltas are written as the next snapshot. A batch starts from the
manifest of the batch before it, so it reads one snapshot and fewer than ``compact_every`` deltas, however long the
stream runs. Each folder is written by one batch only and by its number: a batch that runs again reads what it read and writes
what it wrote, whether it stopped before its manifest or behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.functions.arrays import groups, pieces_of
from cloakframe.functions.patterns import IS_TOKEN, SCAN
from cloakframe.operators.dictionary import distinct_symbols, look_alikes, new_entries
from cloakframe.operators.extract import symbols
from cloakframe.operators.lookups import row_weights
from cloakframe.operators.masking import rename
from cloakframe.session import materialize

ENTRY_SCHEMA = "token string, prefix string, seq bigint, original string, kind string, scope string, n_docs bigint"
DICTIONARY_SCHEMA = f"{ENTRY_SCHEMA}, batch_id bigint"
COMPACT_EVERY = 20


@dataclass
class State:
    """What the dictionary consists of behind a batch: a snapshot (-1: none yet) and the deltas after it."""

    path: str
    snapshot: int
    batch: int

    def folders(self, deltas: str, snapshots: str) -> list[str]:
        first = [f"{self.path}/{snapshots}/upto={self.snapshot}"] if self.snapshot >= 0 else []
        return first + [f"{self.path}/{deltas}/batch_id={n}" for n in range(self.snapshot + 1, self.batch + 1)]

    def entry_folders(self) -> list[str]:
        return self.folders("delta", "snapshot")

    def entries(self, spark: SparkSession) -> DataFrame:
        return _read(spark, self.entry_folders(), DICTIONARY_SCHEMA)

    def alike(self, spark: SparkSession) -> DataFrame:
        return _read(spark, self.folders("alike", "alike_upto"), "token string")


def _read(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def state_behind(spark: SparkSession, path: str, batch: int) -> State:
    """The state that ``batch`` has left; -1 is the state before the first one."""
    if batch < 0:
        return State(path, -1, -1)
    row = spark.read.schema("snapshot bigint").parquet(f"{path}/manifest/batch_id={batch}").first()
    return State(path, row["snapshot"], batch)


def read_stream_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """All entries behind the last finished batch, with the batch that added each."""
    last = spark.read.schema("snapshot bigint, batch_id bigint").parquet(f"{path}/manifest").agg(F.max("batch_id")).first()[0]
    return state_behind(spark, path, last).entries(spark)


def _token_words(batch: DataFrame, language: str) -> DataFrame:
    """Words of code that look like tokens, as symbols: masked like names, they can't be taken for an earlier batch's token."""
    found = groups(pieces_of(F.col("text"), SCAN[language]), lambda p: p.rlike(IS_TOKEN))
    rows = batch.select("doc_id", F.explode(found).alias("s"))
    return rows.select("doc_id", F.col("s.key").alias("name"), F.lit("variable").alias("kind"), F.lit("").alias("scope"), F.col("s.at").alias("at"))


def mask_batch(
    batch: DataFrame, batch_id: int, dictionary_path: str, output_path: str, language: str = "prose", compact_every: int = COMPACT_EVERY
) -> None:
    """Mask one batch; run again for the same batch, it writes the same entries to the same folders.

    New tokens are numbered past those written so far, and none is a look-alike of this batch or an earlier one.
    A later look-alike of an older token is a name itself and gets a token of its own (in code, where it stands outside
    strings and comments). Which names are hot is counted in the batch.
    """
    spark = batch.sparkSession
    before = state_behind(spark, dictionary_path, batch_id - 1)
    known = before.entries(spark)
    batch = materialize(batch, "stream-batch")
    found = symbols(batch, language)
    if language not in ("prose", "quoted"):
        alike = _token_words(batch, language)
        found = found.unionByName(alike.join(found.select("doc_id", "name"), ["doc_id", "name"], "left_anti"))
    found = materialize(found, "stream-symbols")
    look_alikes(batch).write.mode("overwrite").parquet(f"{dictionary_path}/alike/batch_id={batch_id}")
    now = State(dictionary_path, before.snapshot, batch_id)

    fresh = new_entries(known.drop("batch_id"), distinct_symbols(found), now.alike(spark).distinct())
    fresh = fresh.select(*known.drop("batch_id").columns).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    fresh.write.mode("overwrite").parquet(f"{dictionary_path}/delta/batch_id={batch_id}")
    entries = now.entries(spark).drop("batch_id")
    weights = row_weights(found, ["kind", "scope", "name"])
    out = rename(batch, found, entries, language, count_as="n_tokens", weights=weights, stored=True)
    out.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        now.entries(spark).write.mode("overwrite").parquet(f"{dictionary_path}/snapshot/upto={batch_id}")
        now.alike(spark).distinct().write.mode("overwrite").parquet(f"{dictionary_path}/alike_upto/upto={batch_id}")
        now = State(dictionary_path, batch_id, batch_id)
    manifest = spark.createDataFrame([(now.snapshot,)], "snapshot bigint").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{dictionary_path}/manifest/batch_id={batch_id}")


def mask_stream(
    docs: DataFrame,
    dictionary_path: str,
    output_path: str,
    checkpoint: str,
    language: str = "prose",
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Mask a stream of (doc_id, text, …) and extend the dictionary by the names not seen before."""
    return (
        docs.writeStream.foreachBatch(
            lambda batch, batch_id: mask_batch(batch, batch_id, dictionary_path, output_path, language, compact_every)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
