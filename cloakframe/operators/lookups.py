"""Equi-joins against a table with one row per key, kept safe under skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import IN_ROW_SLOTS
from cloakframe.session import materialize

# A key is hot when it holds more than 1/HOT_SHARE of all rows: so there are fewer than
# HOT_SHARE hot keys whatever the size of the data, and their table is always fit to broadcast.
HOT_SHARE = 1000
# Nothing is worth splitting below this many rows per key.
HOT_FLOOR = 100_000
# A key is frequent when it holds more than 1/FREQUENT_SHARE of all rows: fewer than FREQUENT_SHARE keys whatever the
# size of the data, so the part of a table that belongs to them is fit to broadcast too.
FREQUENT_SHARE = 500_000


def hot_keys(weights: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Keys that hold a large share of all rows, with the number of ways to split each."""
    total = weights.agg(F.sum(weight).alias("total")).scalar()
    limit = F.greatest(F.coalesce(total, F.lit(0)) / HOT_SHARE, F.lit(HOT_FLOOR))
    return weights.where(F.col(weight) > limit).select(
        *keys, F.ceil(F.col(weight) / limit).cast("int").alias("_ways")
    )


def row_weights(facts: DataFrame, keys: list[str], weight: str = "n_docs") -> DataFrame:
    """Rows per key, combined on the map side."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))


def heavy_keys(facts: DataFrame, keys: list[str], weight: str = "n_docs") -> DataFrame:
    """``row_weights`` of the keys that can be hot, written: the rows are counted once, however often this is read."""
    return materialize(row_weights(facts, keys, weight).where(F.col(weight) > HOT_FLOOR), "heavy")


def lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    spread: str | None = None,
    weights: DataFrame | None = None,
    weight: str = "n_docs",
) -> DataFrame:
    """Join ``facts`` to ``table`` (unique on ``keys``).

    Whether the table is broadcast is left to the optimizer, which knows its size. For the case
    that it is not, ``weights`` (rows per key) tells which keys are hot: facts of a hot key are
    spread over several partitions by the column ``spread`` and its table row is repeated as often.
    """
    if weights is None or spread is None:
        return facts.join(table, keys, how)
    hot = hot_keys(weights, keys, weight)
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread), F.coalesce("_ways", F.lit(1))).cast("int")
    )
    repeated = table.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))
    )
    # The table is spread thin by its unique keys; hashed per partition, it spares sorting the facts.
    return salted.drop("_ways").join(repeated.drop("_ways").hint("shuffle_hash"), [*keys, "_part"], how).drop("_part")


def lookup_stored(
    facts: DataFrame, table: DataFrame, keys: list[str], weights: DataFrame, weight: str = "n_docs"
) -> DataFrame:
    """Inner join of stored ``facts``, cheap to read twice, to ``table``; ``weights`` (rows per key) tells the frequent keys.

    Facts of frequent keys, by Zipf's law most of them, meet their part of the table where they lie and only the others
    are shuffled. None of the others is frequent, so no partition is filled by one key.
    """
    total = weights.agg(F.sum(weight).alias("total")).scalar()
    frequent = F.broadcast(weights.where(F.col(weight) > total / FREQUENT_SHARE).select(*keys))
    near = facts.join(F.broadcast(table.join(frequent, keys, "left_semi")), keys)
    others = table.join(frequent, keys, "left_anti").hint("shuffle_hash")
    return near.unionByName(facts.join(frequent, keys, "left_anti").join(others, keys))


def frequent_entries(table: DataFrame, key: Column, value: Column, weight: str = "n_docs") -> DataFrame:
    """(key, value) of the frequent keys of ``table``, without those that it has twice; written, as it is read more than once."""
    total = table.agg(F.sum(weight).alias("total")).scalar()
    rows = table.select(key.alias("key"), value.alias("value"), F.col(weight).alias("_weight"))
    frequent = rows.where(F.col("_weight") > total / FREQUENT_SHARE).select("key").distinct()
    once = (
        rows.join(F.broadcast(frequent), "key")
        .groupBy("key")
        .agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("_n"))
        .where("_n = 1 AND value IS NOT NULL")
    )
    return materialize(once.select("key", "value"), "frequent")


def in_row_table(entries: DataFrame) -> DataFrame:
    """(table): ``entries`` (key, value), few and unique, as one row to be asked inside other rows (``with_table``).

    Keys stand in slots by their hash. No row that meets a key here is shuffled to a dictionary and back.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(IN_ROW_SLOTS)).cast("int")
    filed = entries.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("key", "value")).alias("e"))
    none = F.array().cast("array<string>")
    slots = entries.sparkSession.range(IN_ROW_SLOTS).select(F.col("id").cast("int").alias("slot"))
    slots = slots.join(filed, "slot", "left").select(
        "slot", F.coalesce("e.key", none).alias("k"), F.coalesce("e.value", none).alias("v")
    )
    # One row of a bounded table: fewer than FREQUENT_SHARE keys.
    row = slots.agg(F.sort_array(F.collect_list(F.struct("slot", "k", "v"))).alias("s"))
    return materialize(row.select(F.struct(F.col("s.k").alias("k"), F.col("s.v").alias("v")).alias("table")), "in-row")


def with_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the in-row table as column ``_table``.

    It is a scalar subquery, so plans do not show it. The next projection must use it once: then the two are one and a
    row refers to the table; used twice, every row would get a copy.
    """
    return rows.select("*", table.scalar().alias("_table"))
