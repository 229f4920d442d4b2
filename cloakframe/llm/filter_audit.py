"""Audit of how filters interact: what each one removes in every order they can be applied in.

**One pass over the bytes.** Texts are read by a finite-state transducer over UTF-8 bytes, driven by a table: ``MARKS`` gives
for each byte what it emits (part of a word, capital, sign, start of a code point), and ``STATES[state, byte]`` the
next state, between words or inside one. The rows of that table are equal, as the state depends on the last byte alone;
so the states of a whole block are one table look-up and a word starts or ends where neighbouring states differ.

**Verified hash table.** Word spans are inserted into an open-addressing table, all spans of a block at once:
64-bit hashes of eight bytes at a time, seeded by document; a span that meets a taken slot is the same word only
if document, length, hash and then all bytes agree, else it goes on to the next slot. Winners are the distinct words.

**Counts.** The pass leaves one row of flags per text. Equal texts are found by 128 bits of hash and the smallest id per
hash (combined on the map side), joined back by hash and id together, so a text that a third of the rows
share is no hot key. Rows are combined by part and set of failed filters before anything else is computed: a part has
at most 32 sets. All orders come from sums over these sets: what an order's first filters keep depends on
which they are, not on their sequence.

Null texts are empty; an empty text fails A only (0 words). A null part counts as the empty one. Rows of equal id and text are each
other's equals, not smaller ones: all pass E; rows without an id have none smaller and pass E. Repeated label rows count once, 1 if any
is. Null labels count as 0. Extra columns are ignored. Empty tables have no part and give no rows. A task holds some twelve bytes per
byte of its longest text.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind
from cloakframe.llm.common import arrow_map, one_label, utf8, whole_text
from cloakframe.session import materialize

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10  # words; % of words; % of code points
SIGNS = b"#$%&*|"
BLOCK = 1 << 21  # bytes read at a time; a longer text is a block of its own

WORD, CAPITAL, SIGN, POINT = 1, 2, 4, 8
MARKS = np.zeros(256, np.uint8)
MARKS[[b for b in range(256) if b not in b"\x20\x09\x0a\x0b\x0c\x0d"]] |= WORD
MARKS[ord("A") : ord("Z") + 1] |= CAPITAL
MARKS[list(SIGNS)] |= SIGN
MARKS[[b for b in range(256) if b & 0xC0 != 0x80]] |= POINT
BETWEEN, INSIDE = 0, 1
STATES = np.stack([MARKS & WORD] * 2)

_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight


def _lane(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8 k to 8 k + 8 of each span as one number, zeros behind its end."""
    return eights[starts + 8 * k] & _KEEP[np.minimum(lengths - 8 * k, 8)]


def span_hashes(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    made = (seeds.astype(np.uint64) + np.uint64(1)) * _MIX_A ^ lengths.astype(np.uint64)
    left, k = np.arange(len(starts)), 0
    while len(left):
        mixed = (made[left] ^ _lane(eights, starts[left], lengths[left], k)) * _MIX_B
        made[left] = (mixed ^ mixed >> np.uint64(29)) * _MIX_A
        k += 1
        left = left[lengths[left] > 8 * k]
    return made ^ made >> np.uint64(32)


def same_bytes(eights: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of equal length that start at ``a`` and ``b`` have the same bytes."""
    same = np.ones(len(a), bool)
    left, k = np.arange(len(a)), 0
    while len(left):
        equal = _lane(eights, a[left], lengths[left], k) == _lane(eights, b[left], lengths[left], k)
        same[left[~equal]] = False
        k += 1
        left = left[equal & (lengths[left] > 8 * k)]
    return same


def distinct_spans(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The spans that are the first of their owner and bytes to get a slot of the table."""
    size = 1 << max(4, int(2 * len(starts)).bit_length())
    table = np.full(size, -1, np.int64)
    slots = (hashes & np.uint64(size - 1)).astype(np.int64)
    left, winners = np.arange(len(starts)), []
    while len(left):
        slot = slots[left]
        free = table[slot] < 0
        table[slot[free]] = left[free]  # of spans that want the same free slot one gets it
        holder = table[slot]
        won = holder == left
        winners.append(left[won])
        left, holder, slot = left[~won], holder[~won], slot[~won]
        alike = (hashes[left] == hashes[holder]) & (owner[left] == owner[holder]) & (lengths[left] == lengths[holder])
        alike[alike] = same_bytes(eights, starts[left[alike]], starts[holder[alike]], lengths[left[alike]])
        left, slot = left[~alike], slot[~alike]
        slots[left] = (slot + 1) & (size - 1)
    return np.concatenate(winners) if winners else left


def measured(texts: list[bytes]) -> np.ndarray:
    """Per text: words, distinct words, capitals, code points, signs."""
    n = len(texts)
    # A blank before each text ends the last word of the one before; eight behind let spans be read in eights.
    data = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])  # the place of the blank behind text i is ends[i]

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(ends, places, "left"), minlength=n)[:n]

    marks = MARKS[data]
    state = STATES[BETWEEN][data]
    turns = np.flatnonzero(state[1:] != state[:-1]) + 1
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    owner = np.searchsorted(ends, starts, "left")
    eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    first = distinct_spans(eights, starts, lengths, owner, span_hashes(eights, starts, lengths, owner))
    sizes = np.diff(ends, prepend=0) - 1
    return np.stack(
        [
            np.bincount(owner, minlength=n)[:n],
            np.bincount(owner[first], minlength=n)[:n],
            per_text(np.flatnonzero(marks & CAPITAL)),
            sizes - per_text(np.flatnonzero(~marks & POINT)),
            per_text(np.flatnonzero(marks & SIGN)),
        ],
        axis=1,
    )


def text_failures(texts: list[bytes]) -> np.ndarray:
    """The set of the filters A to D that each text fails, as bits."""
    out, at = np.zeros(len(texts), np.int32), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        words, distinct, capitals, points, signs = measured(texts[at:end]).T
        fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, signs > 0]
        out[at:end] = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
        at = end
    return out


def with_failures(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, fails, n): the failed filters as bits, A the lowest; n rows each."""
    text = whole_text()
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fails = pa.array(text_failures(utf8(batch.column("text"))), pa.int32())
        return pa.RecordBatch.from_arrays([*batch.columns[:4], fails], ["doc_id", "part", "h1", "h2", "fails"])

    read = materialize(arrow_map(given, run, f"doc_id {kind}, part string, h1 long, h2 long, fails int"), "failures")
    rows = read.groupBy("doc_id", "part", "h1", "h2", "fails").agg(F.count(F.lit(1)).alias("n"))
    least = read.where("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("least").isNull()
    met = rows.join(least, ["h1", "h2", "doc_id"], "left")
    return met.select("doc_id", "part", F.when(copied, F.col("fails") + SETS // 2).otherwise(F.col("fails")).alias("fails"), "n")


_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _steps() -> Column:
    """All orders with their steps: the filter and, as bits, those before it."""
    rows = []
    for order in _ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            rows.append(f"{order} {step} {FILTERS.index(name)} {before}")
            before |= 1 << FILTERS.index(name)
    fields = "named_struct('o', split(x, ' ')[0], 'step', int(split(x, ' ')[1]), 'f', int(split(x, ' ')[2]), 'b', int(split(x, ' ')[3]))"
    return F.call_function("transform", F.split(F.lit(",".join(rows)), ","), F.expr(f"x -> {fields}"))


def _kept(counts: str) -> str:
    """For each set of filters the rows that fail none of it."""
    return f"transform(sequence(0, {SETS - 1}), q -> aggregate({counts}, 0L, (a, x) -> a + IF((x.m & q) = 0, x.n, 0L)))"


def interaction(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step (from 1), with the counts of that step."""
    rows = with_failures(docs, part)
    known = one_label(labels, "quality").select("doc_id", F.col("label").alias("good")).join(
        one_label(labels, "toxic").select("doc_id", F.col("label").alias("toxic")), "doc_id", "full"
    )
    each = rows.groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n")).join(known, "doc_id", "left")
    counts = each.groupBy("part", "fails").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )

    def gathered(name: str) -> Column:
        return F.collect_list(F.struct(F.col("fails").alias("m"), F.col(name).alias("n"))).alias(name)  # 32 at most

    parts = counts.groupBy("part").agg(gathered("n"), gathered("good"), gathered("toxic"))
    bit = "shiftleft(1, f)"
    over = f"transform(sequence(0, {len(FILTERS) - 1}), f -> aggregate(s.n, 0L, (a, x) -> a + IF((x.m & {bit}) <> 0, {{}}, 0L)))"
    sums = bind(
        f"named_struct('kept', {_kept('s.n')}, 'good', {_kept('s.good')}, 'toxic', {_kept('s.toxic')}, "
        f"'failing', {over.format('x.n')}, 'only', {over.format(f'IF(x.m = {bit}, x.n, 0L)')}, "
        # Of the filters that a row fails each comes first in as many orders.
        f"'shapley', {over.format(f'x.n * ({len(_ORDERS)} div bit_count(x.m))')})",
        n=F.col("n"), good=F.col("good"), toxic=F.col("toxic"),
    )
    spread = parts.select("part", sums.alias("t"), F.explode(_steps()).alias("x"))
    after = "x.b + shiftleft(1, x.f)"

    def lost(name: str) -> str:
        return f"t.{name}[x.b] - t.{name}[{after}]"

    return spread.selectExpr(
        "part", "x.o AS filter_order", "x.step AS step", f"t.kept[{after}] AS kept", f"{lost('kept')} AS removed",
        f"t.failing[x.f] - ({lost('kept')}) AS redundant", "t.only[x.f] AS unique_fails", f"{lost('good')} AS good_lost",
        f"{lost('toxic')} AS toxic_lost", "t.shapley[x.f] AS shapley",
    )
