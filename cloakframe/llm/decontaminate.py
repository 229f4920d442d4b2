"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item; a document word is hit if it lies inside an
occurrence of a window. Finding all occurrences:

1. Both sides hash their k-grams (k = 5) and keep, of each 6 neighbours, the smallest: two texts that
   share a span of 10 words share a kept k-gram inside it (k + 6 - 1 = 10), so none is missed.
2. The kept hashes are joined. A bit table of fixed size, filled by Spark from the benchmark's hashes,
   drops most document hashes in the scan; it never drops one that would join.
3. A joined k-gram brings the hashes of the 5 words before and after it. The hit is extended to both
   sides while words agree; it counts when 10 words or more agree. All extensions together cover exactly the
   occurrences of all windows.

An item of fewer words is one window; it is looked for as a k-gram of its own length, none left out.
Words are compared as 64-bit hashes.

Nulls and texts without words: no words, no hits; items without words have no window. Repeated rows
keep their row; an item_id on several rows counts once; a null item_id is no item, though its windows hit.
Empty tables: an empty result, or nothing hit. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import KEY, arrow_map, keyed, renamed, row_key, utf8, whole_text
from cloakframe.session import materialize

WINDOW = 10
GRAM = 5
KEEP = WINDOW - GRAM + 1  # neighbours of which the smallest is kept
SIDE = WINDOW - GRAM  # words before and after a k-gram that decide
FILTER_BITS = 22
BROADCAST_ROWS = 50_000  # of about 100 bytes; a larger benchmark is joined by shuffle
SALTS = 32

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 200_000
#: Bytes of words (digits, letters, all that is not ASCII) as they are, A-Z in lower case, the rest blank.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() and chr(b) == chr(b).lower() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_L, _R = [f"l{i}" for i in range(SIDE)], [f"r{i}" for i in range(SIDE)]
_CONTEXT = [*_L, *_R]


class _Hashes(dict):
    """Word to 64-bit hash; emptied between texts when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 11)
        return value


def word_hashes(text: bytes, known: _Hashes) -> np.ndarray:
    words = text.translate(_WORDS).split()
    if len(known) > _CACHE:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
    return h ^ (h >> np.uint64(29))


def _grams(words: np.ndarray, length: int, before: np.ndarray | None) -> np.ndarray:
    """Rolling hashes of ``length`` words from those of one word less."""
    n = len(words) - length + 1
    return words[:n] if before is None else before[:n] * _PRIME + words[length - 1 :]


def winnow(h: np.ndarray, keep: int) -> np.ndarray:
    """Positions whose value is the smallest of some ``keep`` neighbours; of ties, all."""
    if len(h) <= keep:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    least = h[: len(h) - keep + 1]
    for i in range(1, keep):
        least = np.minimum(least, h[i : len(h) - keep + 1 + i])
    top = np.full(len(h), 0, np.uint64)
    for i in range(keep):
        part = top[i : i + len(least)]
        np.maximum(part, least, out=part)
    return np.flatnonzero(top == h)


def _context(words: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """Hashes of the words left (nearest first) and right of k-grams; ``outside`` beyond the text."""
    padded = np.concatenate([np.full(SIDE, outside, np.uint64), words, np.full(SIDE, outside, np.uint64)])
    left = [padded[at + SIDE - 1 - i] for i in range(SIDE)]
    right = [padded[at + SIDE + GRAM + i] for i in range(SIDE)]
    return np.stack([*left, *right]) if len(at) else np.zeros((2 * SIDE, 0), np.uint64)


def _found(words: np.ndarray, lengths: list[int], outside: int, seen: np.ndarray | None) -> list[tuple]:
    """(length, positions, hashes, context) per length: WINDOW stands for winnowed k-grams."""
    out, rolling = [], None
    mask = np.uint64((1 << FILTER_BITS) - 1)
    for length in range(1, max([0, *(GRAM if x == WINDOW else x for x in lengths)]) + 1):
        if len(words) < length:
            break
        rolling = _grams(words, length, rolling)
        for kind in [x for x in (length, WINDOW if length == GRAM else 0) if x in lengths]:
            h = _mixed(rolling, kind)
            at = winnow(h, KEEP) if kind == WINDOW else np.arange(len(h))
            if kind == WINDOW and len(words) < WINDOW:
                at = at[:0]
            if seen is not None:
                slot = h[at] & mask
                at = at[(seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            context = _context(words, at, outside) if kind == WINDOW else np.zeros((2 * SIDE, len(at)), np.uint64)
            out.append((kind, at, h[at], context))
    return out


_FIELDS = "fp:bigint,size:int,at:int," + ",".join(f"{c}:bigint" for c in _CONTEXT)


def _list_of(found: list[list[tuple]]) -> pa.Array:
    """One list of structs per text."""
    offsets = np.cumsum([0, *(sum(len(at) for _, at, _, _ in f) for f in found)])
    flat = [x for f in found for x in f if len(x[1])]

    def joined(parts: list[np.ndarray], kind: type) -> pa.Array:
        return pa.array(np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind))

    context = np.concatenate([c for _, _, _, c in flat], axis=1) if flat else np.zeros((2 * SIDE, 0), np.uint64)
    fields = [
        joined([h.view(np.int64) for _, _, h, _ in flat], np.int64),
        joined([np.full(len(at), kind) for kind, at, _, _ in flat], np.int32),
        joined([at for _, at, _, _ in flat], np.int32),
        *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in context),
    ]
    structs = pa.StructArray.from_arrays(fields, names=["fp", "size", "at", *_CONTEXT])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def benchmark_prints(items: DataFrame) -> DataFrame:
    """(item_id, n_words, fp, size, l…, r…): kept hashes of every item with their surroundings."""
    given = items.select("item_id", whole_text().alias("_text"))
    kind = given.schema["item_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, counts, found = _Hashes(), [], []
        for text in utf8(batch.column("_text")):
            words = word_hashes(text, known)
            counts.append(len(words))
            found.append(_found(words, [min(len(words), WINDOW)] if len(words) else [], 0, None))
            if 0 < len(words) < WINDOW:  # the whole item only
                found[-1] = [x for x in found[-1] if x[0] == len(words)]
        return pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array(counts, pa.int32()), _list_of(found)], ["item_id", "n_words", "found"]
        )

    out = arrow_map(given, each, f"item_id {kind}, n_words int, found array<struct<{_FIELDS}>>")
    return out.select("item_id", "n_words", F.explode("found").alias("f")).select(
        "item_id", "n_words", "f.fp", "f.size", *[f"f.{c}" for c in _CONTEXT]
    )


def seen_bits(prints: DataFrame) -> np.ndarray:
    """The bit table of the benchmark's hashes: at most 2^FILTER_BITS / 64 rows come to the driver."""
    slot = F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
    words = prints.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((fp & {(1 << FILTER_BITS) - 1}) & 63 as int))")).alias("bits")
    )
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for row in words.collect():
        out[row["w"]] = row["bits"]
    return out.view(np.uint8)


def document_prints(docs: DataFrame, ids: list[Column], lengths: list[int], seen: np.ndarray) -> DataFrame:
    """The id columns, n_words, and the kept hashes that the bit table lets through."""
    given = docs.select(*ids, whole_text().alias("_text"))
    kept = [f for f in given.schema.fields if f.name != "_text"]
    bits = seen.tobytes()
    outside = 0xFFFFFFFFFFFFFFFF

    def run(batches):
        known, table = _Hashes(), np.frombuffer(bits, np.uint8)
        for batch in batches:
            counts, found = [], []
            for text in utf8(batch.column("_text")):
                words = word_hashes(text, known)
                counts.append(len(words))
                found.append(_found(words, lengths, outside, table))
            columns = [*(batch.column(f.name) for f in kept), pa.array(counts, pa.int64()), _list_of(found)]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "n_words", "found"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return given.mapInArrow(run, f"{schema}, n_words long, found array<struct<{_FIELDS}>>")


def _agreeing(names: list[str]) -> Column:
    """How many words agree, from the nearest outwards."""
    out = F.lit(SIDE)
    for i in reversed(range(SIDE)):
        out = F.when(F.col(f"d.{names[i]}") != F.col(f"b.{names[i]}"), F.lit(i)).otherwise(out)
    return out


def _hits(found: DataFrame, contexts: DataFrame, small: bool) -> DataFrame:
    """(_row, start, end, context) of joined and extended hits."""
    if small:
        joined = found.alias("d").join(F.broadcast(contexts.alias("b")), ["fp", "size"])
    else:
        salted = found.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
        copies = contexts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.alias("d").join(copies.alias("b"), ["fp", "size", "_salt"])
    whole = F.col("size") == WINDOW
    left, right = _agreeing(_L), _agreeing(_R)
    return (
        joined.select(
            F.col("d._row").alias("_row"),
            F.col("b.context").alias("context"),
            F.when(whole, F.col("d.at") - left).otherwise(F.col("d.at")).alias("start"),
            F.when(whole, F.col("d.at") + GRAM + right).otherwise(F.col("d.at") + F.col("size")).alias("end"),
            whole.alias("_whole"),
        )
        .where(~F.col("_whole") | (F.col("end") - F.col("start") >= WINDOW))
        .drop("_whole")
    )


def _covered(spans: Column) -> Column:
    """Words inside at least one of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, ids: list[Column] | None = None) -> DataFrame:
    """The id columns, n_words, n_hit, item_ids (sorted as strings) per document row."""
    prints = materialize(benchmark_prints(items), "benchmark")
    # The hashes stay apart by kind of window and by surroundings; items with the same share them.
    named = prints.withColumn("context", F.xxhash64("fp", "size", *_CONTEXT))
    contexts = named.select("fp", "size", *_CONTEXT, "context").distinct()
    named = named.where(F.col("item_id").isNotNull()).select("context", "item_id").distinct()
    lengths = [r[0] for r in prints.select("size").distinct().collect()]  # at most WINDOW values
    small = prints.count() <= BROADCAST_ROWS
    given = ids or [F.col("doc_id")]
    scanned = materialize(
        document_prints(docs, given, sorted(lengths), seen_bits(prints)).withColumn("_row", F.monotonically_increasing_id()),
        "scanned",
    )
    names = [c for c in scanned.columns if c not in ("found", "n_words", "_row")]
    found = scanned.select("_row", F.explode("found").alias("f")).select("_row", "f.fp", "f.size", "f.at", *[f"f.{c}" for c in _CONTEXT])
    hits = materialize(_hits(found, contexts, small), "hits")
    spans = hits.groupBy("_row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    pairs = hits.select("_row", "context").distinct()
    if small:
        pairs = pairs.join(F.broadcast(named), "context")
    else:
        salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
        copies = named.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        pairs = salted.join(copies, ["context", "_salt"])
    items_of = pairs.groupBy("_row").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    none = F.array().cast("array<string>")
    return (
        scanned.drop("found")
        .join(spans, "_row", "left")
        .join(items_of, "_row", "left")
        .select(
            *names,
            "n_words",
            F.coalesce(_covered("spans"), F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", none).alias("item_ids"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a hit."""
    bad = contamination(docs, items, row_key()).where("n_hit > 0").select(*KEY).distinct()
    given, names = keyed(docs)
    return given.join(renamed(bad, names), names, "left_anti").drop(*names)
