"""Language model: a probabilistic suffix tree over the bytes of normalised texts.

A text is its words (A-Z in lower case, cut at blanks), joined by one blank, and an end symbol (written as a line break,
which no word holds). Symbols are bytes. For every context of up to ``DEPTH`` symbols all training texts are
counted. A context stays in the tree if its next-symbol distribution diverges from that of the context one symbol shorter:
N(c) · KL(P(·|c) ‖ P(·|parent)) must reach ``LEAST_GAIN`` bits per training symbol, whatever the size of the corpus, and
what describing its distribution costs (``COST`` · log2 N(c) bits for each symbol seen after it), so that chance does not pass. As a
divergence is at most N(c) · log2(N / N(c)) bits, this bounds the contexts of one length by about 30 / LEAST_GAIN, and in
practice far below. Distributions are smoothed towards the parent's by Witten and Bell's rule, the root's by adding one.

Scoring takes for each symbol the state of the longest retained suffix. For that the tree is compiled to an automaton
(one table of next states, one of log10 probabilities), and pieces of texts run through it side by side in numpy; a
piece starts DEPTH symbols early, after which its state is exact. So whole texts are scored at some 100 MB a second and core.

The base model counts words with add-one smoothing. Counts of the most frequent words (``TOP_WORDS`` at most) are
given to the scan, those of all others come by a join with the words of each document that are not among them. Words are told apart
by 64-bit hashes.

Null and empty texts are one end token. Repeated rows count and are scored as often as they stand; a null doc_id is in no
held-out fold. Empty tables give empty results; without training rows every symbol has 1/256 and base_score is 0. Extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import utf8, whole_text
from cloakframe.session import materialize

DEPTH = 6
LEAST_GAIN = 2e-6
COST = 0.5
TOP_WORDS = 1 << 18
END = b"\n"
_PIECE = 512  # symbols of a piece that is run through the automaton
_AT_ONCE = 500_000  # bytes counted or scored together; some 50 bytes of memory for each
_CACHE = 50_000  # words whose hashes or counts are held
_GRAMS = 1_000_000  # grams held; if merging leaves over half of them, they are handed on
_WORD, _GRAM, _DOCS = 0, 1, 2


def stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other, DEPTH end symbols before each and one after it; where each begins."""
    parts = [END * DEPTH + b" ".join(words) + END for words in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def grams(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each symbol of a text itself and the DEPTH before it, packed: the symbol in the lowest byte."""
    wide = symbols.astype(np.uint64)
    packed = wide[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        packed |= wide[DEPTH - back : len(wide) - back] << np.uint64(8 * back)
    own = np.ones(len(symbols), bool)
    for i in range(DEPTH):
        own[starts[:-1] + i] = False
    return packed[own[DEPTH:]]


def _counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their summed counts."""
    if counts is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if counts is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(counts, first)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): words by hash, packed grams, and the number of texts; summed over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = texts = 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 200_000):
                part = keys[at : at + 200_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[at : at + 200_000].astype(np.int64))],
                    ["kind", "key", "n"],
                )

        def word_rows() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            yield from rows(_WORD, keys, np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        def gram_rows() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                yield from rows(_GRAM, *_counted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])))
            held.clear()
            size = 0

        for batch in batches:
            pa.default_memory_pool().release_unused()  # else the batches before stay with the worker
            given = utf8(batch.column("_text"))
            texts += len(given)
            at = 0
            while at < len(given):
                cut, end = [], at
                length = 0
                while end < len(given) and length < _AT_ONCE:
                    cut.append(given[end].lower().split())
                    length += len(given[end])
                    end += 1
                at = end
                for each in cut:
                    words.update(each)
                held.append(_counted(grams(*stream(cut))))
                size += len(held[-1][0])
                if size > _GRAMS:
                    merged = _counted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                    held[:], size = [merged], len(merged[0])
                    if size > _GRAMS // 2:
                        yield from gram_rows()
                if len(words) > _CACHE:
                    yield from word_rows()
        yield from word_rows()
        yield from gram_rows()
        yield from rows(_DOCS, np.zeros(1, np.uint64), np.array([texts]))

    found = docs.select(whole_text().alias("_text")).mapInArrow(run, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _low(key: Column, n_bytes: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1).cast("long"))


def retained(full: DataFrame, least_gain: float = LEAST_GAIN, cost: float = COST) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that pass the divergence test, and the next-symbol counts of all that are in the tree.

    ``full`` has (key, n) for grams of DEPTH + 1 symbols. Returns the contexts as (length, packed), then arrays
    length, packed gram, count.
    """
    total = full.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [], *(np.zeros(0, np.int64) for _ in range(3))
    levels = {DEPTH: materialize(full.select("key", "n"), "level")}
    for d in range(DEPTH - 1, -1, -1):
        levels[d] = materialize(levels[d + 1].groupBy(_low(F.col("key"), d + 1).alias("key")).agg(F.sum("n").alias("n")), "level")
    need = least_gain * total
    kept, counts = [], []
    for d in range(1, DEPTH + 1):
        sums = levels[d].groupBy(F.shiftright("key", 8).alias("c")).agg(F.sum("n").alias("of"))
        # No context below this can gain enough.
        sums = sums.where(F.col("of") * F.log2(F.lit(float(total)) / F.col("of")) >= need)
        parents = levels[d - 1].select(F.col("key").alias("up"), F.col("n").alias("up_n"))
        rows = levels[d].withColumn("c", F.shiftright("key", 8)).join(sums, "c")
        rows = rows.withColumn("up", _low(F.col("key"), d)).join(parents, "up")
        gain = (
            rows.groupBy("c")
            .agg(
                F.sum(F.col("n") * F.log2(F.col("n") / F.col("up_n"))).alias("part"),
                F.first("of").alias("of"),
                F.count(F.lit(1)).alias("kinds"),
            )
        )
        if d == 1:
            gain = gain.withColumn("up_of", F.lit(total))
        else:
            wide = levels[d - 1].groupBy(F.shiftright("key", 8).alias("up_c")).agg(F.sum("n").alias("up_of"))
            gain = gain.withColumn("up_c", _low(F.col("c"), d - 1)).join(wide, "up_c")
        gain = (
            gain.withColumn("gain", F.col("part") + F.col("of") * F.log2(F.col("up_of") / F.col("of")))
            .where((F.col("gain") >= need) & (F.col("gain") >= cost * F.col("kinds") * F.log2(F.col("of") + 1)))
        )
        passed = np.sort(gain.select("c").toPandas()["c"].to_numpy(np.int64))
        kept.extend((d, int(c)) for c in passed)
    # A context brings its shorter ones.
    tree = {(d, c & ((1 << (8 * d)) - 1)) for top, c in kept for d in range(1, top + 1)}
    spark = full.sparkSession
    for d in range(DEPTH + 1):
        if d == 0:
            found = levels[0].toPandas()
        else:
            own = sorted(c for x, c in tree if x == d)
            if not own:
                continue
            wanted = spark.createDataFrame(pa.table({"c": pa.array(own, pa.int64())}))
            found = levels[d].withColumn("c", F.shiftright("key", 8)).join(F.broadcast(wanted), "c", "left_semi").select("key", "n").toPandas()
        counts.append((np.full(len(found), d, np.int8), found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)))
    return sorted(tree), *(np.concatenate(x) for x in zip(*counts))


@dataclass
class Automaton:
    """codes: symbol class per byte; step and gain: next state and log10 probability per state and class."""

    codes: np.ndarray
    step: np.ndarray
    gain: np.ndarray

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text."""
        symbols, starts = stream(texts)
        own = self.codes[symbols]
        width, n = self.step.shape[1], len(own)
        pieces = -(-n // _PIECE)
        padded = np.full(DEPTH + pieces * _PIECE, self.codes[END[0]], own.dtype)
        padded[DEPTH : DEPTH + n] = own
        lanes = np.lib.stride_tricks.sliding_window_view(padded, DEPTH + _PIECE)[::_PIECE]
        columns = np.ascontiguousarray(lanes.T)
        step, gain = self.step.ravel(), self.gain.ravel()
        state = np.zeros(pieces, np.int64)  # times the width, it may pass 31 bits
        out = np.empty((_PIECE, pieces), np.float32)
        for t in range(DEPTH + _PIECE):
            at = state * width + columns[t]
            if t >= DEPTH:
                out[t - DEPTH] = gain[at]
            state = step[at].astype(np.int64)
        flat = np.ascontiguousarray(out.T).ravel()[:n].astype(float)
        for i in range(DEPTH):
            flat[starts[:-1] + i] = 0
        return np.add.reduceat(flat, starts[:-1]) if len(texts) else np.zeros(0)


def compile_tree(tree: list[tuple[int, int]], depth: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Automaton:
    """The automaton whose state is the longest suffix among the contexts and their beginnings."""
    root = depth == 0
    seen = np.unique(np.concatenate([gram[root], [END[0]]])) if root.any() else np.array([END[0]])
    codes = np.full(256, len(seen), np.int32)  # one class for all bytes that no training text has
    codes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    strings = {c.to_bytes(d, "big") for d, c in tree}
    states = sorted({s[:i] for s in strings for i in range(len(s) + 1)} | {b""}, key=lambda s: (len(s), s))
    number = {s: i for i, s in enumerate(states)}
    rows = np.zeros((len(states), width), np.float32)
    # A context is packed with its length in front, so that each is looked up once.
    contexts, own = np.unique((depth.astype(np.int64) << 48) | (gram >> 8), return_inverse=True)
    places = np.array([number[(x & ((1 << 48) - 1)).to_bytes(x >> 48, "big")] for x in contexts.tolist()], np.int64)
    np.add.at(rows, (places[own], codes[gram & 0xFF]), count)
    step = np.zeros((len(states), width), np.int32)
    fail = np.zeros(len(states), np.int64)
    total = float(count[root].sum())
    share = (rows[0] + 1) / (total + 256)
    share[-1] = 1 / (total + 256)
    rows[0] = share
    children: dict[int, list[tuple[int, int]]] = {}
    for s, i in number.items():
        if s:
            children.setdefault(number[s[:-1]], []).append((s[-1], i))
    for i, s in enumerate(states):
        if i:
            # The parent in the tree is the longest proper suffix; fail was set when the state before was read.
            if s in strings:
                n, kinds = rows[i].sum(), np.count_nonzero(rows[i])
                rows[i] = (rows[i] + kinds * rows[fail[i]]) / (n + kinds) if n else rows[fail[i]]
            else:
                rows[i] = rows[fail[i]]
            step[i] = step[fail[i]]
        for byte, child in children.get(i, []):
            fail[child] = step[fail[i]][codes[byte]] if i else 0
            step[i][codes[byte]] = child
    return Automaton(codes, step, np.log10(rows, out=rows))


def _top_words(counts: DataFrame, most: int = TOP_WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of all words with at least a certain count, ``most`` at most; and that count."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["b"], r["count"]) for r in counts.groupBy(step.alias("b")).count().collect()), reverse=True)
    held, lowest = 0, None
    for b, n in sizes:
        if held + n > most:
            break
        held, lowest = held + n, b
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.iinfo(np.int64).max
    found = counts.where((step >= lowest)).select("key", "n").toPandas()
    keys, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order], lowest


@dataclass
class Model:
    """What the scan needs, and the totals of the base model."""

    automaton: Automaton
    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int
    end: int


def fit(docs: DataFrame, least_gain: float = LEAST_GAIN, top_words: int = TOP_WORDS, cost: float = COST) -> tuple[Model, DataFrame]:
    """The model, and (key, n) of the words that it doesn't hold itself."""
    counts = materialize(corpus_counts(docs), "counts")
    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    totals = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    end = counts.where(F.col("kind") == _DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys, n, lowest = _top_words(words, top_words)
    rare = words.where(F.floor(F.log2("n") * 8) < lowest) if len(keys) else words
    tree = retained(counts.where(F.col("kind") == _GRAM).select("key", "n"), least_gain, cost)
    automaton = compile_tree(*tree)
    return Model(automaton, keys, n, totals["n"] + end, totals["v"] + (end > 0), end), rare


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def score_texts(docs: DataFrame, model: Model, rare_words: DataFrame, ids: list[Column]) -> DataFrame:
    """The id columns, n_tokens, n_known, train_tokens, base_score, score."""
    given = docs.select(*ids, whole_text().alias("_text"))
    kept = [f for f in given.schema.fields if f.name != "_text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        known_hashes = _Hashes()
        logs = np.append(np.log10(m.counts + 1.0), 0.0)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            given = utf8(batch.column("_text"))
            at = 0
            while at < len(given):
                end, size, texts = at, 0, []
                while end < len(given) and size < _AT_ONCE:
                    texts.append(given[end].lower().split())
                    size += len(given[end]) + 40
                    end += 1
                lengths = np.array([len(t) for t in texts])
                if len(known_hashes) > _CACHE:
                    known_hashes.clear()
                hashes = np.fromiter(map(known_hashes.__getitem__, chain.from_iterable(texts)), np.uint64, lengths.sum())
                place, inverse = np.unique(hashes, return_inverse=True)
                found = np.searchsorted(m.keys, place)
                hit = (m.keys[np.minimum(found, len(m.keys) - 1)] == place) if len(m.keys) else np.zeros(len(place), bool)
                value = logs[np.where(hit, found, len(m.counts))]
                starts = np.concatenate([[0], np.cumsum(lengths)])
                owner = np.repeat(np.arange(len(texts)), lengths)
                top = np.bincount(owner, value[inverse], minlength=len(texts))
                n_top = np.bincount(owner, hit[inverse], minlength=len(texts))
                # What is left, as distinct (text, word) with the number of times.
                left = np.flatnonzero(~hit[inverse])
                pair, times = np.unique(owner[left] * len(place) + inverse[left], return_counts=True)
                who, what = np.divmod(pair, max(1, len(place)))
                offsets = np.searchsorted(who, np.arange(len(texts) + 1))
                structs = pa.StructArray.from_arrays(
                    [pa.array(place[what].view(np.int64)), pa.array(times.astype(np.int32))], names=["key", "times"]
                )
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(f.name) for f in kept),
                        pa.array(lengths + 1, pa.int64()),
                        pa.array(n_top.astype(np.int64)),
                        pa.array(top.astype(float)),
                        pa.array(m.automaton.score(texts)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                    ],
                    [*(f.name for f in kept), "n_tokens", "_known", "_sum", "score", "_left"],
                )
                at = end

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    scanned = materialize(
        given.mapInArrow(
            run, f"{schema}, n_tokens long, _known long, _sum double, score double, _left array<struct<key:bigint,times:int>>"
        ).withColumn("_row", F.monotonically_increasing_id()),
        "scored",
    )
    shared.destroy()  # what it was for has been written
    # A word that no training text has finds no partner; should one be hot, AQE splits its side of the join.
    left = scanned.select("_row", F.explode("_left").alias("w")).select("_row", "w.key", "w.times")
    more = (
        left.join(rare_words, "key")
        .groupBy("_row")
        .agg(F.sum("times").alias("_more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more_sum"))
    )
    spread = float(np.log10(model.tokens + model.vocabulary + 1))
    end_known, end_log = int(model.end > 0), float(np.log10(model.end + 1))
    nothing = F.lit(0)
    return scanned.join(more, "_row", "left").select(
        *[f.name for f in kept],
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", nothing) + end_known).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_sum") + F.coalesce("_more_sum", F.lit(0.0)) + end_log - F.col("n_tokens") * spread).alias("base_score"),
        "score",
    )
