"""SimHash near-duplicates, compared bit-sliced.

1. Every text gets a 64-bit fingerprint from the XXH64 of its word shingles.
2. Equal fingerprints meet once: from here on there is one row per distinct fingerprint.
3. Fingerprints that differ in few bits share whole parts. Cut into five parts, a difference of at
   most three bits leaves two of them untouched, so each fingerprint goes under the ten pairs of its
   parts. (Radius r needs r + 2 parts.) No candidate is lost and a key has some 26 bits.
4. Inside a key, bit planes are stored vertically: one word holds the same bit of 64 fingerprints.
   Distances of a query to 64 fingerprints are counted at once with carry-save adders; a query
   whose counters have all passed the radius is dropped before the remaining planes.
5. A block returns the links of its components to their smallest member, never all pairs.

A key with many members is cut into blocks by a hash, and every pair of blocks is a task row of
its own, so that a hot key is spread and no task holds more than two blocks.

Null texts are empty ones; texts without words have fingerprint 0 and are linked like any other.
Repeated rows and equal ids each keep their row. Null ids keep their row too and are never the
smallest id of a component unless it has no other (then component_id is null). Empty tables give
empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import KEY, arrow_map, keyed, renamed, row_key, unsigned_hex, utf8, whole_text
from cloakframe.llm.components import connected_components
from cloakframe.operators.lookups import lookup
from cloakframe.session import materialize

SEED = 42
BITS = 64
BLOCK = 2048  # members of a key that are compared in one piece
_CHUNK = 1 << 15  # shingles whose bits are unpacked at a time


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text: bit set if set in over half the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    widths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(widths) - 1
    starts = ends - widths + 1
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, ids: list[Column] | None = None) -> DataFrame:
    """The id columns (doc_id when none are given) and ``fp``, the fingerprint as a long."""
    given = docs.select(*(ids or [F.col("doc_id")]), whole_text().alias("_text"))
    kept = [f for f in given.schema.fields if f.name != "_text"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((simhash(t, shingle) for t in utf8(batch.column("_text"))), np.uint64, batch.num_rows)
        columns = [batch.column(f.name) for f in kept] + [pa.array(found.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return arrow_map(given, each, f"{schema}, fp long")


def part_keys(fp: Column, radius: int) -> Column:
    """One long per pair of parts: a hash of which pair and its bits (a clash only adds a comparison)."""
    parts = radius + 2
    edges = [BITS * i // parts for i in range(parts + 1)]
    cut = [
        F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(edges, edges[1:])
    ]
    keys = []
    for number, (i, j) in enumerate(combinations(range(parts), 2)):
        width = edges[j + 1] - edges[j]
        both = F.shiftleft(cut[i], width).bitwiseOR(cut[j])
        keys.append(F.xxhash64(F.lit(number), both))
    return F.array(*keys)


def within(fps: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix: row q has the bits of all members at most ``radius`` bits from member q.

    Counters of three bits and an overflow bit per member are kept as words; ``radius`` is at most 7.
    """
    m = len(fps)
    words = -(-m // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:m] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # 64 × words
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    masks = np.where(bits[:m].T == 1, full, np.uint64(0))  # 64 × m, all ones where the query has the bit
    out = np.zeros((m, words), np.uint64)
    rows = np.arange(m)
    c0, c1, c2, over = (np.zeros((m, words), np.uint64) for _ in range(4))
    for plane in range(BITS):
        carry = planes[plane][None, :] ^ masks[plane][rows][:, None]
        c0, carry = c0 ^ carry, c0 & carry
        c1, carry = c1 ^ carry, c1 & carry
        c2, carry = c2 ^ carry, c2 & carry
        over |= carry
        if plane % 8 == 7 and plane > 8:
            alive = (~(over | _above(c0, c1, c2, radius))).any(axis=1)
            if not alive.all():
                rows, c0, c1, c2, over = rows[alive], c0[alive], c1[alive], c2[alive], over[alive]
                if not len(rows):
                    return out
    near = ~(over | _above(c0, c1, c2, radius))
    if m % 64:
        near[:, -1] &= np.uint64((1 << (m % 64)) - 1)
    out[rows] = near
    return out


def _above(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Where the three-bit counter is over the radius."""
    over = np.zeros_like(c0)
    for value in range(radius + 1, 8):
        over |= (c0 if value & 1 else ~c0) & (c1 if value & 2 else ~c1) & (c2 if value & 4 else ~c2)
    return over


def block_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for each further member of each component inside the block."""
    fps = np.unique(fps.view(np.int64)).view(np.uint64)
    m = len(fps)
    near = within(fps, radius)
    several = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little").sum(axis=1, dtype=np.int64) > 1
    waiting = np.zeros(near.shape[1] * 64, bool)
    waiting[:m] = several
    left, right = [], []
    for first in np.flatnonzero(several):
        if not waiting[first]:
            continue
        waiting[first] = False
        members, front = [], np.array([first])
        while len(front):
            reached = np.bitwise_or.reduce(near[front], axis=0)
            front = np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little").view(bool) & waiting)
            waiting[front] = False
            members.append(front)
        found = np.concatenate(members)
        left.append(fps[found])
        right.append(np.full(len(found), fps[first]))
    if not left:
        empty = np.zeros(0, np.uint64)
        return empty, empty
    return np.concatenate(left), np.concatenate(right)


def near_links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect what is connected at ``radius`` bits; ``distinct`` has ``fp``, each once.

    Every pair at most ``radius`` bits apart is compared; what is returned per block is a
    spanning set of links, which keeps components and leaves out the pairs they imply.
    """
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold distances up to 7")
    keyed = distinct.select("fp", F.explode(part_keys(F.col("fp"), radius)).alias("key"))
    sized = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sized, "key").withColumn("_of", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("_of")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_of") - 1),
        lambda other: F.struct(F.least(other, mine).alias("i"), F.greatest(other, mine).alias("j")),
    )
    dealt = met.select("fp", "key", F.explode(pairs).alias("p")).select("fp", "key", "p.i", "p.j")
    spread = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None

        def links() -> pa.RecordBatch:
            u, v = block_links(np.concatenate(held), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            fps = batch.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            if last is None or (group[:, 0] != last).any():
                starts = np.concatenate([[0], starts])
            at = 0
            # Small groups are compared together: what is near is near whatever key brought it here.
            for start in starts.tolist():
                held.append(fps[at:start])
                size += start - at
                at = start
                if size >= 512:
                    yield links()
                    held, size = [], 0
            held.append(fps[at:])
            size += len(fps) - at
            last = group[:, -1]
        if size > 1:
            yield links()

    return spread.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, ids: list[Column] | None = None) -> DataFrame:
    """The id columns, ``doc_id``, ``fp``, ``root`` (a fingerprint that names the component) and ``component_id``:
    the smallest doc_id reachable."""
    prints = materialize(fingerprints(docs, shingle, [F.col("doc_id"), *(ids or [])]), "fingerprints")
    distinct = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs")), "distinct"
    )
    parts = connected_components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "root", "component_id", "n_docs"), "components")
    return lookup(
        prints, named.select("fp", "root", "component_id"), ["fp"], spread="doc_id", weights=named.select("fp", "n_docs")
    )


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each component: that of the smallest id.

    Of rows that also have the same id the one with the smallest row key stays, of rows equal in id
    and text any one. Rows without an id stay only where their component has no other.
    """
    found = near_duplicates(docs, shingle, radius, row_key())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)
    # By root: an id may stand on rows of several components.
    stays = found.groupBy("root").agg(F.min(order).alias("o")).select(*[F.col(f"o.{k}") for k in KEY])
    given, names = keyed(docs)
    return given.join(renamed(stays, names), names, "left_semi").dropDuplicates(names).drop(*names)


def fingerprint_text(fp: Column) -> Column:
    return unsigned_hex(fp)
