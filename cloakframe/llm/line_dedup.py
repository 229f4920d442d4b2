"""Line dedup: lines that many documents share stay in one document only.

The lines of a text (cut at ``\\n``) are exploded under a key: blanks stripped at both ends, A-Z in lower case, as
128 bits of hash. Distinct documents are counted per key (first combined per key and document, then per key, both
on the map side, so a line that every document holds is no hot group). Keys of ``least_docs`` documents and more
are joined back to the exploded lines; keys that hold over a thousandth of these rows are split by document.
What travels are hashes and positions. At the end each text meets the positions it loses, in one join by
its row key, and is put together again from the runs of lines between them, in time linear in its lines.

The document with the largest doc_id that holds a key keeps all its lines of that key. Keys of fewer than
``least_chars`` code points are never counted nor dropped.

Other columns, a length of the text among them, stay as they are. A document is a doc_id: rows of equal id count once, and the rows of the largest id all keep their lines. Rows without
an id count as one document, smaller than all others. A null or empty text is one empty line; a text
that loses all lines is empty. Repeated rows are returned as often as they come. Extra columns are kept; the
caller names the added ones. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind
from cloakframe.llm.common import KEY, fresh, keyed, row_key, whole_text
from cloakframe.operators.lookups import lookup
from cloakframe.session import materialize

LEAST_CHARS, LEAST_DOCS = 40, 5
_BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["_hash_a", "_hash_b"]

# The lines between dropped places d, which are sorted: the run before each, and the one behind the last.
_RUNS = (
    "transform(sequence(0, size(s.d)), k -> slice(s.l, IF(k = 0, 0, s.d[k - 1] + 1) + 1, "
    "IF(k = size(s.d), size(s.l), s.d[k]) - IF(k = 0, 0, s.d[k - 1] + 1)))"
)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row key, position, hash) of every line whose key is long enough."""
    exploded = docs.select("doc_id", *row_key(), F.posexplode(F.split(whole_text(), "\n", -1)).alias("_at", "_line"))
    key = F.col("_line")
    return (
        exploded.withColumn("_line", F.btrim("_line", F.lit(_BLANKS)))
        .where(F.length(key) >= least_chars)
        .withColumn("_line", ascii_lower(key))
        # The first value seeds the next one's hash: two hashes of the key that don't depend on each other.
        .select("doc_id", *KEY, "_at", F.xxhash64(key).alias(HASH[0]), F.xxhash64(F.lit(1), key).alias(HASH[1]))
    )


def repeated_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(hash, n_docs, last): keys in enough documents, with the largest id that holds them."""
    counted = lines.groupBy(*HASH).agg(
        F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull().cast("long")).alias("none")
    )
    n_docs = F.col("n") + F.col("none")
    return counted.where(n_docs >= least_docs).select(*HASH, n_docs.alias("n_docs"), "last")


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(row key, dropped): the places, sorted, of the lines that each text loses; only texts that lose some."""
    lines = long_lines(docs, least_chars)
    found = materialize(repeated_lines(lines, least_docs), "repeated-lines")
    held = lookup(lines, found, HASH, "inner", spread=KEY[0], weights=found)
    return held.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy(*KEY).agg(
        F.array_sort(F.collect_set("_at")).alias("dropped")
    )


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """``docs`` with the lines that stay as text, and the numbers of lines before and of lines dropped.

    Columns of ``docs`` named like ``counts`` go.
    """
    taken = {c.lower() for c in counts}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    rows, names = keyed(docs)
    lost = dropped_lines(docs, least_chars, least_docs)
    places = fresh(rows, "_dropped")
    lost = lost.select(*[F.col(k).alias(n) for k, n in zip(KEY, names)], F.col("dropped").alias(places))
    met = rows.join(lost, names, "left")
    gone = F.col(places)
    kept = F.array_join(bind(f"flatten({_RUNS})", l=F.split(whole_text(), "\n", -1), d=gone), "\n")
    text = F.when(gone.isNull(), whole_text()).otherwise(kept)
    n_lines = F.length(whole_text()) - F.length(F.replace(whole_text(), F.lit("\n"), F.lit(""))) + 1
    return met.select(
        *[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns],
        n_lines.cast("long").alias(counts[0]),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias(counts[1]),
    )
