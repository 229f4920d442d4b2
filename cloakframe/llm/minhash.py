"""MinHash fingerprints of documents.

Shingles are five words (lower case, by blanks). A shingle's hash combines the hashes of its words; ``PERMUTATIONS``
universal hash functions a·h + b (mod 2^64) are minimised over all shingles of a text, whole texts in
blocks of shingles in numpy. 16 bits of the mixed minimum make the fingerprint; the share of equal places
estimates the Jaccard similarity of the shingle sets.

``edited`` pairs each document with the one that follows in descending doc_id (after the last comes the
first). No global window is needed: ids are cut into ranges by quantiles, a range is one sorted run, and the
first document of the following range is added to it as a guest. Texts are shuffled once.

``near_duplicate_classes`` groups near copies: signature bands are joined in Spark, and every proposed pair is
verified by the Jaccard similarity of its full shingle sets; pairs that links to a center imply or exclude are left out.

Null texts are empty. Texts of fewer than five words are one shingle of all words; texts without words share
one fingerprint (likeness 1 among them). Equal ids follow each other in the order of their row keys; null
ids come last. A table of one row is its own next document. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import KEY, row_key, utf8, whole_text
from cloakframe.llm.components import connected_components
from cloakframe.operators.lookups import lookup
from cloakframe.session import materialize

SHINGLE = 5
PERMUTATIONS = 128
BAND = 4  # places of a band: 32 bands meet a pair of similarity 0.8 with probability 1 - 5e-8
SIMILAR = 0.8
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21  # texts of a center, and their shingles, that are compared in one piece
_ROUNDING = 1e-9
SEED = 5
RANGES_PER_PARTITION = 4
_BLOCK = 1 << 15  # shingles hashed at a time
_CACHE = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(SEED)
_A = _draw.integers(1 << 62, (1 << 63) - 1, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, (1 << 63) - 1, PERMUTATIONS, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 23)
        return value


def shingle_hashes(text: bytes, known: dict, shingle: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash per shingle, repeats included; none for a text without words."""
    words = text.lower().split()
    if len(known) > _CACHE:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out = out * _PRIME + h[i : n + i]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(size)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit minima per text; all ones for a text without shingles."""
    out = np.full((len(sets), PERMUTATIONS), 0xFFFF, np.uint16)
    held: list[int] = []
    size = 0

    def flush() -> None:
        flat = np.concatenate([sets[i] for i in held])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in held])[:-1]]).astype(np.int64)
        buffer = np.empty_like(flat)
        for p in range(PERMUTATIONS):
            np.multiply(flat, _A[p], out=buffer)
            np.add(buffer, _B[p], out=buffer)
            # The minima of long texts all have small high bits; mixed, any 16 bits tell them apart.
            least = np.minimum.reduceat(buffer, starts)
            out[held, p] = (((least ^ (least >> np.uint64(29))) * _PRIME) >> np.uint64(48)).astype(np.uint16)

    for i, one in enumerate(sets):
        if len(one):
            held.append(i)
            size += len(one)
            if size >= _BLOCK:
                flush()
                held, size = [], 0
    if held:
        flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _ranges(docs: DataFrame) -> tuple[list[int], int]:
    """Quantiles of doc_id that cut the table into some ranges per shuffle partition."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES_PER_PARTITION * parts
    shares = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or [])), n


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are below the id (by halving); -1 for null, which comes last in descending order."""
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    rounds = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(table, middle) < doc_id, F.lit(False))
        going = a["lo"] < a["hi"]
        return F.struct(
            F.when(going & below, middle + 1).otherwise(a["lo"]).alias("lo"),
            F.when(going & ~below, middle).otherwise(a["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.when(doc_id.isNull(), -1).otherwise(F.aggregate(rounds, start, halve, lambda a: a["lo"]))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _range, _guest): every range sorted in its partition, its guest at the end."""
    cuts, _ = _ranges(docs)
    spread = _range_of(F.col("doc_id"), cuts)
    # One row per range, at most len(cuts) + 2 of them.
    tops = docs.select("doc_id", spread.alias("r")).groupBy("r").agg(F.max("doc_id").alias("top")).collect()
    held = sorted(((r["r"], r["top"]) for r in tops), reverse=True)
    guests = [(held[(i + 1) % len(held)][1], r) for i, (r, _) in enumerate(held)]
    table = docs.sparkSession.createDataFrame(guests, "_top long, _to int")
    given = docs.select("doc_id", whole_text().alias("text"), *row_key())
    to = table.groupBy("_top").agg(F.collect_list("_to").alias("_to"))
    joined = given.join(F.broadcast(to), F.col("doc_id").cast("long").eqNullSafe(F.col("_top")), "left")
    places = F.concat(
        F.array(F.struct(spread.alias("r"), F.lit(False).alias("guest"))),
        F.coalesce(F.transform("_to", lambda r: F.struct(r.alias("r"), F.lit(True).alias("guest"))), F.array()),
    )
    return (
        joined.select("doc_id", "text", *KEY, F.explode(places).alias("p"))
        .select("doc_id", "text", *KEY, F.col("p.r").alias("_range"), F.col("p.guest").alias("_guest"))
        .repartition("_range")
        .sortWithinPartitions("_range", "_guest", F.desc_nulls_last("doc_id"), *KEY)
        .drop(*KEY)
    )


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they and the next document's are."""
    ordered = in_order(docs)
    kind = ordered.schema["doc_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        last: tuple | None = None  # range, guest, id, text, signature
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            ranges, guests = batch.column("_range").to_pylist(), batch.column("_guest").to_pylist()
            at = 0
            # Few texts at a time: their edited texts and hashes are held as well.
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and size < 2_000_000:
                    size += len(texts[end])
                    end += 1
                own = signatures([shingle_hashes(t.encode(), known) for t in texts[at:end]])
                pairs, edited = [], []
                for i in range(at, end):
                    now = (ranges[i], guests[i], ids[i], texts[i], own[i - at])
                    if last is not None and last[0] == now[0] and not last[1]:
                        n = len(last[3])
                        edited.append(last[3][: n - n // 3] + now[3][: n // 3])
                        pairs.append((last, now))
                    last = now
                at = end
                if not pairs:
                    continue
                new = signatures([shingle_hashes(t.encode(), known) for t in edited])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], id_type or batch.column("doc_id").type),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                        pa.array([as_text(a[4]) for a, _ in pairs]),
                        pa.array([as_text(s) for s in new]),
                        pa.array([likeness(a[4], s) for (a, _), s in zip(pairs, new)]),
                        pa.array([likeness(a[4], b[4]) for a, b in pairs]),
                    ],
                    _OUT,
                )

    return ordered.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _rep() -> Column:
    """The name of a text: equal texts share it."""
    return F.xxhash64(whole_text())


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, rep, bands): rep names the text, bands are its signature, four places in one number."""
    given = docs.select("doc_id", whole_text().alias("text"), _rep().alias("rep"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            sets = [shingle_hashes(t, known) for t in utf8(batch.column("text"))]
            bands = np.ascontiguousarray(signatures(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rep"), pa.array(list(bands), pa.list_(pa.int64()))], ["doc_id", "rep", "bands"]
            )

    return given.mapInArrow(run, f"doc_id {kind}, rep long, bands array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles): the sorted shingle sets of the texts in ``wanted`` (rep, first_id), read again from the documents."""
    own = docs.select("doc_id", whole_text().alias("text"), _rep().alias("_rep"))
    met = own.join(wanted, (F.col("_rep") == F.col("rep")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = met.groupBy("rep").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, known)).view(np.int64) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return texts.mapInArrow(run, "rep long, shingles array<long>")


def _past_centers(rings: DataFrame, sets: DataFrame, parts: DataFrame, similar: float) -> DataFrame | None:
    """(rep, center): links between texts near a center and texts that are not, where no class holds both yet.

    ``rings`` has (rep, center, size, near, apart). The texts of a center are cut into blocks by a hash; each pair of blocks is
    a group of its own, read as a stream behind its block of near texts. One link to a center's texts is enough for a text.
    """
    root = parts.select(F.col("node").alias("rep"), "root")
    of = root.select(F.col("rep").alias("center"), F.col("root").alias("center_root"))
    outer = rings.where("NOT near").join(root, "rep", "left").join(of, "center", "left")
    same = F.coalesce("root", "rep") == F.coalesce("center_root", "center")
    outer = materialize(outer.where(~same).select("rep", "center", "size", "near", "apart"), "outer")
    centers = outer.groupBy("center").agg(F.min("apart").alias("_least"), *_blocks("_outer"))
    # Only those far enough from the center can be similar to one outside.
    inner = rings.where("near").join(centers.select("center", "_least"), "center").where(F.col("apart") >= F.col("_least") - (1 - similar) - _ROUNDING)
    inner = materialize(inner.select("rep", "center", "size", "near", "apart"), "inner")
    counts = materialize(centers.join(inner.groupBy("center").agg(*_blocks("_inner")), "center"), "blocks")
    if counts.isEmpty():
        return None

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine, others = F.pmod(F.xxhash64("rep"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        at = rows.join(counts, "center").select("rep", "center", "near", mine.alias(own), others.alias(other))
        return at.select("center", "_inner", "_outer", "near", "rep")

    pairs = dealt(inner, "_inner", "_outer").unionByName(dealt(outer, "_outer", "_inner")).join(sets, "rep")
    group = ["center", "_inner", "_outer"]
    spread = pairs.repartition(*group).sortWithinPartitions(*group, F.desc("near"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reps, held, flat = None, [], [], None
        for batch in batches:
            left, right = [], []
            shingles = batch.column("shingles")
            rows = zip(*(batch.column(c).to_pylist() for c in (*group, "near", "rep")))
            for i, (center, inner, outer, near, rep) in enumerate(rows):
                if (center, inner, outer) != last:
                    last, reps, held, flat = (center, inner, outer), [], [], None
                own = shingles[i].values.to_numpy(zero_copy_only=False).view(np.uint64)  # sorted as unsigned
                if near:
                    reps.append(rep)
                    held.append(own)
                    continue
                if not reps:
                    continue
                if flat is None:
                    flat, sizes = np.concatenate(held), np.array([len(h) for h in held])
                    starts, held = np.concatenate([[0], np.cumsum(sizes)]), []
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat if len(own) else np.zeros(len(flat), bool)
                common = np.diff(np.concatenate([[0], np.cumsum(hit)])[starts])
                linked = np.flatnonzero(common >= similar * (sizes + len(own) - common))
                if len(linked):
                    left.append(rep)
                    right.append(reps[linked[0]])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["rep", "center"])

    return materialize(spread.mapInArrow(run, "rep long, center long"), "past")


def _blocks(name: str) -> list[Column]:
    """Into how many blocks the texts of a center go."""
    return [F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias(name)]


def _linked(reps: list[int], bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray, band: int, similar: float) -> list[tuple[int, int]]:
    """Links that connect what is similar among the texts of one bucket, or between its two blocks (``side`` 0 and 1).

    A pair counts in the first band that it has in common, so it is looked at once. Signatures are compared first, six
    standard deviations below the similarity asked for; what passes and isn't connected yet is verified by its shingles.
    """
    prints = bands.view(np.uint16)
    least = PERMUTATIONS * similar - 6 * np.sqrt(PERMUTATIONS * similar * (1 - similar))
    root = list(range(len(reps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    both = side.min() != side.max()
    out = []
    for i in range(len(reps)):
        others = np.flatnonzero(side > side[i]) if both else np.arange(i + 1, len(reps))
        if not len(others):
            continue
        others = others[(bands[others] == bands[i]).argmax(axis=1) == band]
        others = others[(prints[others] == prints[i]).sum(axis=1) >= least]
        for j in others.tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            own, other = sets[i], sets[j]
            common = len(np.intersect1d(own, other, assume_unique=True))
            if common >= similar * (len(own) + len(other) - common):
                root[b] = a
                out.append((reps[i], reps[j]))
    return out


def _among_others(left: DataFrame, reps: DataFrame, similar: float) -> DataFrame:
    """(rep, center): links among the texts (rep, band, value) of a bucket that are not similar to its center.

    Buckets are cut into blocks by a hash; each pair of blocks is a group of its own, so a bucket of any size is
    spread, in one pass whatever number of texts in it are unlike each other.
    """
    size = reps.select("rep", F.size("shingles").alias("size"))
    sized = left.join(size, "rep").groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), *_blocks("_of")).where("n > 1")
    met = left.join(sized, ["band", "value"])
    mine = F.pmod(F.xxhash64("rep"), F.col("_of"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_of") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"))
    )
    dealt = met.select("rep", "band", "value", mine.alias("mine"), F.explode(pairs).alias("p")).select("rep", "band", "value", "mine", "p.i", "p.j")
    group = ["band", "value", "i", "j"]
    rows = dealt.join(reps.select("rep", "bands", "shingles"), "rep")
    spread = rows.repartition(*group).sortWithinPartitions(*group, "rep").select(*group, "mine", "rep", "bands", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def found() -> pa.RecordBatch:
            links: list[tuple[int, int]] = []
            if len(held) > 1:
                side = np.array([m != last[2] for m, *_ in held], np.int8) if last[2] != last[3] else np.zeros(len(held), np.int8)
                links = _linked([r for _, r, _, _ in held], np.stack([b for _, _, b, _ in held]), [x for *_, x in held], side, last[0], similar)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["rep", "center"])

        for batch in batches:
            bands, shingles = batch.column("bands"), batch.column("shingles")
            keys = zip(*(batch.column(c).to_pylist() for c in (*group, "mine", "rep")))
            for at, (*key, mine, rep) in enumerate(keys):
                if key != last:
                    if held:
                        yield found()
                    last, held = key, []
                own = shingles[at].values.to_numpy(zero_copy_only=False).view(np.uint64)
                held.append((mine, rep, bands[at].values.to_numpy(zero_copy_only=False), own))
        if held:
            yield found()

    return materialize(spread.mapInArrow(run, "rep long, center long"), "others")


def near_duplicate_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id): smallest doc_id of the class; classes are connected by verified pairs.

    In each band bucket all texts are compared with the smallest, its center. Those that are not similar to it are compared
    among themselves, in blocks (``_among_others``), and with those that are, unless a class already holds both
    (``_past_centers``). The number of passes does not depend on how many texts a bucket has or how unlike they are.
    """
    prints = materialize(_prints(docs), "prints")
    reps = materialize(
        prints.groupBy("rep").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs"), F.any_value("bands").alias("bands")),
        "reps",
    )
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    centers = buckets.groupBy("band", "value").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(buckets.join(centers.drop("n"), ["band", "value"]).where("rep <> center"), "met")
    # Shingles are made of the texts that share a bucket with another one only.
    several = met.select("rep").unionByName(met.select(F.col("center").alias("rep"))).distinct()
    sets = materialize(_shingle_sets(docs, reps.select("rep", "first_id").join(several, "rep", "left_semi")), "shingles")
    common = F.size(F.array_intersect("a.shingles", "b.shingles"))
    whole = F.size("a.shingles") + F.size("b.shingles") - common
    judged = materialize(
        met.select("rep", "center").distinct()
        .join(sets.alias("a"), "rep")
        .join(sets.select(F.col("rep").alias("center"), "shingles").alias("b"), "center")
        .select(
            "rep", "center", F.size("a.shingles").alias("size"), (common >= similar * whole).alias("near"),
            F.when(whole > 0, 1 - common / whole).otherwise(0.0).alias("apart"),
        ),
        "judged",
    )
    left = materialize(met.join(judged.where("NOT near"), ["rep", "center"]).select("rep", "band", "value"), "others-of-buckets")
    links = judged.where("near").select("rep", "center").unionByName(_among_others(left, reps.select("rep", "bands").join(sets, "rep"), similar))
    # 1 - Jaccard is a metric: a text further from the center can't be similar to one that is similar to it.
    rings = judged.where(F.col("apart") <= 2 * (1 - similar) + _ROUNDING)
    parts = connected_components(links)
    found = _past_centers(rings, sets, parts, similar)
    if found is not None:
        parts = connected_components(links.unionByName(found))
    rooted = reps.select("rep", "first_id", "n_docs").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = materialize(rooted.join(least, "root").select("rep", "class_id", "n_docs"), "classes")
    return lookup(
        prints.select("doc_id", "rep"), named.select("rep", "class_id"), ["rep"], spread="doc_id", weights=named.select("rep", "n_docs")
    ).select("doc_id", "class_id")
