"""What the operators share: reading tables, row identity, label folds, joins with small tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null text as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


KEY = ["_key_a", "_key_b"]


def row_key(names: list[str] = KEY) -> list[Column]:
    """128 bits that name a row by its doc_id and text, so that stages can find it again.

    Nulls are allowed; rows equal in both columns share the key.
    """
    text = whole_text()
    return [
        F.xxhash64(F.col("doc_id"), text).alias(names[0]),
        F.xxhash64(text, F.lit(1), F.col("doc_id")).alias(names[1]),
    ]


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with marks behind it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its row key, under names that no column has."""
    names = [fresh(docs, k) for k in KEY]
    return docs.select("*", *row_key(names)), names


def renamed(keys: DataFrame, names: list[str]) -> DataFrame:
    """A table of row keys, its columns called as in ``keyed``."""
    return keys.select(*[F.col(k).alias(n) for k, n in zip(KEY, names)])


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id has no fold and counts as -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label 0/1): one row per id, 1 if any of its rows says so; nulls give none."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )


def bounded_sample(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the whole row; all rows if there are fewer.

    The rows must be distinct: equal ones go or stay together. A share is kept, not a top-k, so no task
    sees more than its own rows.
    """
    total = rows.count()
    if total <= bound:
        return rows
    place = F.pmod(F.xxhash64(F.lit(7), *[F.col(f"`{c}`") for c in rows.columns]), F.lit(1 << 30))
    return rows.where(place < int((1 << 30) * bound / total))


LABELLED = "_label"


def labelled_keys(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(row key, label): every distinct row of ``docs`` whose id has a label, as its key.

    Ids are joined, not texts, and repeated rows are one: samples of these keys bound rows, also where one
    labelled id stands on very many rows.
    """
    known = one_label(labels, label).withColumnRenamed("label", LABELLED)
    keys = docs.select("doc_id", *row_key()).distinct().join(known, "doc_id")
    return materialize(keys.select(*KEY, LABELLED).distinct(), "labelled-keys")


def rows_of_keys(docs: DataFrame, keys: DataFrame, **columns: Column) -> DataFrame:
    """(row key, label, …): ``columns`` of the rows that a bounded sample of ``labelled_keys`` names.

    Repeated rows repeat: make the result distinct before it leaves the executors.
    """
    given = docs.select(*row_key(), *[c.alias(n) for n, c in columns.items()])
    return given.join(F.broadcast(keys), KEY)


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``each`` on every Arrow batch (64 MB at most by Spark's setting)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def unsigned_hex(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
