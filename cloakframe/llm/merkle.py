"""Merkle manifest of a dataset, with a witness for every row, by incremental appends.

A row's leaf is the hash of its fields. The leaves of a source, by doc_id, are the lowest level of a tree: every ``ARITY``
neighbours become the hash of their digests (the last run may be shorter), level by level, until one node is left. The
tops of the sources, by source, are the leaves of one more tree; its top names the whole dataset.

- **Streaming aligned append.** Leaves are numbered inside their source (range partitions, no global window) and dealt in
  aligned blocks of ``ARITY ** HEIGHT``. A task reads its blocks in order and appends leaf after leaf (``Appender``). A node that
  joins open siblings takes their digests as left steps of its partial witness; the later arrival of a sibling
  extends the witnesses of all leaves under the earlier ones by a right step; a completed run extends them by a step up.
- **Block roots are further appends.** A block is an aligned subtree, so its top is a node of level ``HEIGHT`` of
  its source. These nodes are appended in the same way, in blocks, until every source is one node: a source with a
  third of all rows is spread over its blocks, and a round has 1/729 of the rows of the one before.
- What the rounds have added to a witness is joined by block: at most 729 rows share a key.

Witnesses are bytes: ``L`` or ``R`` and the digest of a sibling, ``^`` for one level up. ``fold`` recomputes the root from a leaf
and its witness alone.

Null fields are ``-``, which no value can look like. Null sources come first and are one source; null doc_ids come first;
rows of equal doc_id follow by leaf, equal rows are interchangeable. Only the five fields of a leaf are read; the caller
names the columns to carry along. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.lookups import lookup
from cloakframe.session import materialize

ARITY = 3
HEIGHT = 6  # levels of a block: 729 leaves
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UP, _LEFT, _RIGHT = b"^", b"L", b"R"


def joined_hash(digests: list[bytes]) -> bytes:
    """The hash of digests, which are written as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_hash(**replaced: Column) -> Column:
    """Hex sha256 of a row's fields, each as its byte count and value; ``replaced`` gives other values for fields."""
    values = [replaced.get(name, F.col(name)).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


class Appender:
    """A tree that grows leaf by leaf: the open nodes of each level, and the witness so far of each leaf."""

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, int, int]]] = []  # per level: digest, first leaf, end of leaves
        self.witness: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.witness.append(bytearray())
        self._join(0, digest, len(self.witness) - 1, len(self.witness))

    def _extend(self, first: int, end: int, step: bytes) -> None:
        for i in range(first, end):
            self.witness[i] += step

    def _join(self, level: int, digest: bytes, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        if run:
            self._extend(first, end, b"".join(_LEFT + d for d, _, _ in run))
            self._extend(run[0][1], run[-1][2], _RIGHT + digest)
        run.append((digest, first, end))
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        first, end = run[0][1], run[-1][2]
        self._extend(first, end, _UP)
        self._join(level + 1, joined_hash([d for d, _, _ in run]), first, end)

    def close(self, height: int | None) -> bytes:
        """Complete the open runs from below, up to ``height`` or else until one node is left; returns it."""
        level = 0
        while True:
            run = self.open[level]
            if level == height or height is None and len(run) == 1 and not any(self.open[level + 1 :]):
                return run[0][0]
            if run:
                self._complete(level)
            level += 1


def fold(leaf: bytes, witness: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its witness lead to, and the hash of all siblings in their order."""
    at, left, right, siblings = 0, [], [], []
    while at < len(witness):
        kind = witness[at : at + 1]
        if kind == _UP:
            leaf, left, right, at = joined_hash([*left, leaf, *right]), [], [], at + 1
            continue
        digest = witness[at + 1 : at + 33]
        (left if kind == _LEFT else right).append(digest)
        siblings.append(digest)
        at += 33
    return leaf, joined_hash(siblings)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in its group from 0, and ``total``, the size of the group.

    Rows are range-partitioned and take their place inside their partition; the first number of each part of a
    group comes from a table with one row per partition and group. Equal rows may be cut apart (``_tie``).
    """
    placed = (
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(group, *order, "_tie")
        .sortWithinPartitions(group, *order)
        .drop("_tie")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33))
    )
    placed = materialize(placed, "placed")
    parts = placed.groupBy("_part", group).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "_part",
        group,
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("n").over(whole).alias("total"),
    )
    return (
        placed.join(starts, ["_part", group])
        .withColumn("at", F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def _finished(rows: pa.Table, keys: list[tuple], height: int) -> Iterator[pa.RecordBatch]:
    """Whole blocks with the witnesses of their rows and the tops of the blocks."""
    digests, totals = rows["digest"].to_pylist(), rows["total"].to_pylist()
    witness: list[bytes] = []
    tops: list[bytes] = []
    first = 0
    while first < len(keys):
        tree, end = Appender(), first
        while end < len(keys) and keys[end] == keys[first]:
            tree.append(digests[end])
            end += 1
        top = tree.close(height if totals[first] > ARITY**height else None)
        witness += map(bytes, tree.witness)
        tops += [top] * (end - first)
        first = end
    made = rows.append_column("witness", pa.array(witness, pa.binary())).append_column("top", pa.array(tops, pa.binary()))
    yield from made.combine_chunks().to_batches()


def _append(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Blocks lie behind each other; the last one of a batch waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = list(zip(rows["group"].to_pylist(), rows["block"].to_pylist()))
        last = len(keys)
        while last and keys[last - 1] == keys[-1]:
            last -= 1
        if last:
            yield from _finished(rows.slice(0, last), keys[:last], height)
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield from _finished(held, list(zip(held["group"].to_pylist(), held["block"].to_pylist())), height)


def appended(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One round: ``nodes`` (group, at, total, digest, …) with block, witness in the block, and top of the block."""
    dealt = (
        nodes.withColumn("block", F.expr(f"at div {ARITY**height}"))
        .repartition("group", "block")
        .sortWithinPartitions("group", "block", "at")
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return materialize(dealt.mapInArrow(lambda batches: _append(batches, height), f"{kinds}, witness binary, top binary"), "appended")


def climbed(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(group, at, witness, top): each node's witness up to the top of its group."""
    made = appended(nodes, height)
    if made.where(F.col("total") > ARITY**height).isEmpty():
        return made.select("group", "at", "witness", "top")
    above = climbed(block_nodes(made, height), height).select(
        "group", F.col("at").alias("block"), F.col("witness").alias("rest"), F.col("top").alias("last")
    )
    return made.join(above, ["group", "block"]).select("group", "at", F.concat("witness", "rest").alias("witness"), F.col("last").alias("top"))


def block_nodes(made: DataFrame, height: int) -> DataFrame:
    """The tops of blocks as nodes of the next round."""
    return made.where(f"at % {ARITY**height} = 0").select(
        "group", F.col("block").alias("at"), F.expr(f"(total + {ARITY**height - 1}) div {ARITY**height}").alias("total"), F.col("top").alias("digest")
    )


def manifest(docs: DataFrame, height: int = HEIGHT, **carried: Column) -> DataFrame:
    """(doc_id, source, leaf, …, witness, subroot, root) per row; digests in hex, the witness as bytes.

    ``carried`` are further columns, computed from ``docs``; blocks have ``ARITY ** height`` leaves. The order of leaves in a source is by doc_id, then leaf.
    """
    group = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # not null, in the order of sources
    leaves = docs.select("doc_id", "source", group.alias("group"), F.unhex(leaf_hash()).alias("digest"), *[c.alias(n) for n, c in carried.items()])
    leaves = materialize(leaves, "leaves")
    made = appended(numbered(leaves, "group", ["doc_id", "digest"]), height)

    blocks = materialize(climbed(block_nodes(made, height), height), "blocks")
    tops = blocks.groupBy("group").agg(F.first("top").alias("digest"), F.count(F.lit(1)).alias("n_blocks"))
    tops = numbered(tops.select(F.lit("").alias("all"), F.col("group").alias("name"), "digest", "n_blocks"), "all", ["name"])
    tops = materialize(tops.withColumnRenamed("all", "group"), "tops")
    above = climbed(tops.select("group", "at", "total", "digest"), height).select("at", F.col("witness").alias("last"), F.col("top").alias("root"))
    sources = tops.join(above, "at").select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "n_blocks", "last", "root")

    rest = lookup(blocks, materialize(sources, "sources"), ["group"], "inner", spread="at", weights=sources, weight="n_blocks")
    rest = rest.select("group", F.col("at").alias("block"), F.concat("witness", "last").alias("rest"), "subroot", "root")
    return made.join(rest, ["group", "block"]).select(
        "doc_id",
        "source",
        F.lower(F.hex("digest")).alias("leaf"),
        *carried,
        F.concat("witness", "rest").alias("witness"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lower(F.hex("root")).alias("root"),
    )


def _folded(leaf: pd.Series, witness: pd.Series) -> pd.DataFrame:
    found = [fold(bytes.fromhex(d), bytes(w)) for d, w in zip(leaf, witness)]
    return pd.DataFrame({"root": [r.hex() for r, _ in found], "proof_sha256": [p.hex() for _, p in found]}, dtype=object)


def folded(leaf: str, witness: str) -> Column:
    """struct<root, proof_sha256>: the root that a leaf (hex) and its witness lead to, and the hash of the witness' siblings."""
    return F.pandas_udf(_folded, "root string, proof_sha256 string")(leaf, witness)
