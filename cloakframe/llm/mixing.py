"""Mixing sources to target weights by Poisson replication.

Source s holds c_s characters (a document counts one more than its text has) and shall make up the share p_s of a
mixture of T characters. Each of its documents is then repeated p_s T / c_s times on average: its number of copies
is a Poisson variable of that mean, inverted from a hash of seed and doc_id. So copies are drawn independently in
the scan, are the same on every run and every partitioning, and a fraction of a repetition costs no rounding.
Means over ``PIECE`` are drawn as a sum of equal parts, each from its own hash.

The copies are shuffled globally: each goes to the partition and the place that a hash of doc_id and copy number
names, which spreads a hot source evenly.

Only totals per source are aggregated (combined on the map side). The table of sources is broadcast if it
has at most ``BROADCAST_SOURCES`` rows, else joined with salted sources.

Null or empty texts count one character. A null source is a source of its own. A null doc_id is replaced by a
hash of the text. Equal ids get equal numbers of copies. Without target weights p_s is proportional to
c_s^ALPHA; sources that a given table of weights lacks, or gives a weight of 0, go. Extra columns are kept;
those named like the two that are added go. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import fresh

ALPHA = 0.5
SEED = 2024
PIECE = 16
LEVELS = 96  # steps of the distribution function of a mean up to PIECE; the rest is below 1e-40
BROADCAST_SOURCES = 10_000
SALTS = 64
ADDED = ["copy_no", "shuffle_key"]


def _named() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))


def _uniform(name: str, part: Column, seed: int) -> Column:
    """From 0 to below 1, by 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), name, part.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: DataFrame | None = None, alpha: float = ALPHA, size: Column | None = None) -> DataFrame:
    """(source, rate): mean number of copies of each document of a source.

    ``targets`` is (source, weight), any positive scale; ``size`` the length of the mixture in characters,
    that of the input if not given.
    """
    held = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars"))
    if targets is None:
        weighed = held.withColumn("weight", F.pow("chars", F.lit(alpha)))
    else:
        given = targets.groupBy("source").agg(F.sum("weight").alias("weight")).where("weight > 0")
        weighed = held.alias("h").join(given.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).select(
            "h.source", "chars", "weight"
        )
    total = weighed.agg(F.sum("weight").alias("w")).scalar()
    whole = size if size is not None else held.agg(F.sum("chars").alias("c")).scalar()
    return weighed.select("source", (F.col("weight") / total * whole / F.col("chars")).alias("rate"))


def _steps(rate: Column) -> Column:
    """The distribution function of the Poisson variable at 0, 1, …"""
    start = F.struct(F.array(F.exp(-rate)).alias("f"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def next_one(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(F.concat(a["f"], F.array(a["c"] + p)).alias("f"), p.alias("p"), (a["c"] + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, next_one, lambda a: a["f"])


def mix(
    docs: DataFrame, targets: DataFrame | None = None, alpha: float = ALPHA, seed: int = SEED, size: Column | None = None
) -> DataFrame:
    """The columns of ``docs``, copy_no (from 0) and shuffle_key, one row per copy, shuffled by the key."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    name, salt, parts, steps, copies = (fresh(docs, c) for c in ("_name", "_salt", "_parts", "_steps", "_copies"))
    plan = rates(docs, targets, alpha, size).withColumn(parts, F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    plan = plan.select(F.col("source").alias("source"), parts, _steps(F.col("rate") / F.col(parts)).alias(steps))
    named = docs.withColumn(name, _named())
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    if plan.count() <= BROADCAST_SOURCES:
        joined = named.alias("d").join(F.broadcast(plan.alias("p")), same)
    else:
        salted = named.withColumn(salt, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        repeated = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.alias("d").join(repeated.alias("p"), same & (F.col(f"d.{salt}") == F.col(f"p.{salt}")))
    draws = F.transform(F.sequence(F.lit(0), F.col(f"p.{parts}") - 1), lambda i: _uniform(name, i, seed))
    reached = F.col(f"p.{steps}")
    counted = joined.withColumn(
        copies, F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter(reached, lambda s: u >= s)))
    ).where(F.col(copies) > 0)
    exploded = counted.select(
        *[F.col(f"d.`{c}`") for c in docs.columns], name, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("copy_no")
    )
    key = F.substring(F.md5(F.concat_ws("|", F.lit("order"), F.lit(str(seed)), name, F.col("copy_no").cast("string"))), 1, 16)
    keyed = exploded.select(*[F.col(f"`{c}`") for c in docs.columns], "copy_no", key.alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
