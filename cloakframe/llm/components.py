"""Connected components of a graph given as links, by alternating large and small stars.

Each round moves links towards the smallest node of their component; the number of rounds is
about the logarithm of the component's size. A hub never meets all its links in one task: minima are
combined on the map side, and the joins that give them back are split by AQE when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.session import materialize


def _facts(links: DataFrame) -> tuple:
    """Number of links and an order-free sum of their hashes (as decimal: no overflow)."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger node ``u`` to the smaller ``v``."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node.

    ``links`` has two columns of one comparable type; direction, repeats, loops and nulls don't
    matter. No links: an empty result.
    """
    a, b = links.columns
    now = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    facts = _facts(now)
    while facts[0]:
        now = materialize(_small_star(_large_star(now)), "links")
        before, facts = facts, _facts(now)
        if facts == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
