"""The dictionary: one row per token, built, extended, looked up and summarised.

Columns: token, prefix, seq, original, kind, scope, n_docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.arrays import pieces_of
from cloakframe.functions.patterns import (
    GROUP_ORDER,
    IS_TOKEN,
    KIND_GROUP,
    KIND_PREFIX,
    OTHER_PREFIX,
    PREFIX_LABEL,
    WORD,
)
from cloakframe.operators.lookups import lookup, row_weights
from cloakframe.session import materialize

KEY = ["kind", "scope", "original"]


def _mapped(column: Column, table: dict[str, str], default: str) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*entries)[column], F.lit(default))


def prefix_of(kind: Column) -> Column:
    return _mapped(kind, KIND_PREFIX, OTHER_PREFIX)


def group_of(kind: Column) -> Column:
    return _mapped(kind, KIND_GROUP, "Other")


def group_rank(group: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), group).cast("bigint")


def qualified(scope: Column, name: Column) -> Column:
    return F.when(scope != "", F.concat(scope, F.lit("::"), name)).otherwise(name)


def token_text(prefix: Column, seq: Column) -> Column:
    """Three digits at least, more when the number needs them; null when there is no number."""
    return F.when(seq.isNotNull(), F.format_string("%s_%03d", prefix, seq))


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """(kind, scope, original, n_docs): the aggregate is combined on the map side first."""
    return symbols.groupBy("kind", "scope", F.col("name").alias("original")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )


def assign_tokens(distinct: DataFrame, label: str = "dictionary") -> DataFrame:
    """Number symbols per prefix in sorted order.

    One window per prefix would sort nearly all names in a single task. Here the symbols are
    range-partitioned, each takes its place inside its partition, and the first number of every
    (partition, prefix) block comes from a table with one row per block.
    """
    order = ["prefix", "kind", "scope", "original"]
    placed = (
        distinct.withColumn("prefix", prefix_of(F.col("kind")))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33))
    )
    placed = materialize(placed, label)
    blocks = placed.groupBy("_part", "prefix").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    earlier = Window.partitionBy("prefix").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and prefix: a few thousand rows on any cluster.
    starts = blocks.select(
        "_part", "prefix", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    seq = (F.col("_before") + F.col("_row") - F.col("_first") + 1).cast("bigint")
    return (
        placed.join(F.broadcast(starts), ["_part", "prefix"])
        .withColumn("seq", seq)
        .select(
            token_text(F.col("prefix"), F.col("seq")).alias("token"),
            "prefix",
            "seq",
            "original",
            "kind",
            "scope",
            "n_docs",
        )
    )


def look_alikes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token): distinct words of the input that look like tokens."""
    word = r"(?<![\p{L}\p{N}_])g[vftcsnmx]_[0-9]{3,}+(?![\p{L}\p{N}_])"
    text = F.col(text_col)
    some = docs.where(text.rlike(r"g[vftcsnmx]_[0-9]{3}"))
    return some.select(F.explode(F.regexp_extract_all(text, F.lit(word), F.lit(0))).alias("token")).distinct()


# Numbers of the input's look-alikes that new tokens are numbered past.
_DIGITS = 12


def taken_numbers(tokens: DataFrame) -> DataFrame:
    """(prefix, taken): the largest number per prefix; at most one row for each of the prefixes.

    Numbers of over 12 digits are left out: starting past them would use up the range. They are met, if
    at all, one by one (``free_of``).
    """
    return tokens.where(F.length("token") <= 3 + _DIGITS).groupBy(F.substring("token", 1, 2).alias("prefix")).agg(
        F.max(F.expr("substring(token, 4)").cast("bigint")).alias("taken")
    )


def numbered_after(entries: DataFrame, last: DataFrame) -> DataFrame:
    """Entries numbered after the given number (prefix, _last) of their prefix."""
    return (
        entries.join(F.broadcast(last), "prefix", "left")
        .withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0)))
        .withColumn("token", token_text(F.col("prefix"), F.col("seq")))
        .select(*entries.columns)
    )


def free_of(entries: DataFrame, foreign: DataFrame | None) -> DataFrame:
    """``entries`` without a token that is a word of the input (``foreign``, token), whatever its number.

    Entries that meet one are numbered again past the last one of their prefix, until none does. Look-alikes
    of up to 12 digits are passed by ``taken_numbers``, so this joins only longer ones, if there are any.
    """
    if foreign is None:
        return entries
    long = foreign.where(F.length("token") > 3 + _DIGITS)
    if long.isEmpty():
        return entries
    entries = materialize(entries, "numbered")
    while True:
        met = materialize(entries.join(long, "token", "left_semi"), "met")
        if met.isEmpty():
            return entries
        again = assign_tokens(met.select("kind", "scope", "original", "n_docs"), "again")
        last = entries.groupBy("prefix").agg(F.max("seq").alias("_last"))
        moved = numbered_after(again, last).select(*entries.columns)
        entries = materialize(entries.join(met.select("token"), "token", "left_anti").unionByName(moved), "numbered")


def build_dictionary(symbols: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """Dictionary of all (name, kind, scope) rows; written once, so that tokens stay as they are.

    No token is among ``foreign`` (token), the words of the input that look like tokens.
    """
    entries = assign_tokens(distinct_symbols(symbols), "symbols")
    if foreign is not None:
        entries = numbered_after(entries, taken_numbers(foreign).withColumnRenamed("taken", "_last"))
    return materialize(free_of(entries, foreign), "dictionary")


def new_entries(existing: DataFrame, seen: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """Entries for the symbols (kind, scope, original, n_docs) that ``existing`` lacks, numbered after its last ones."""
    fresh = assign_tokens(seen.join(existing.select(*KEY), KEY, "left_anti"), "new-symbols")
    last = existing.select("prefix", "seq")
    if foreign is not None:
        last = last.unionByName(taken_numbers(foreign).withColumnRenamed("taken", "seq"))
    return free_of(numbered_after(fresh, last.groupBy("prefix").agg(F.max("seq").alias("_last"))), foreign)


def merge_dictionary(existing: DataFrame, symbols: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """Known symbols keep their token, new ones are numbered after the last one of their prefix."""
    seen = distinct_symbols(symbols)
    fresh = new_entries(existing, seen, foreign).select(*existing.columns)
    kept = (
        existing.join(seen.withColumnRenamed("n_docs", "_more"), KEY, "left")
        .withColumn("n_docs", F.col("n_docs") + F.coalesce("_more", F.lit(0)))
        .select(*existing.columns)
    )
    return kept.unionByName(fresh)


def symbol_files(symbols: DataFrame, dictionary: DataFrame, file_col: str) -> DataFrame:
    """(token, file): the files of each token as rows, since one token may be in all files."""
    pairs = symbols.select(
        "kind", "scope", F.col("name").alias("original"), F.col(file_col).alias("file")
    ).distinct()
    return lookup(
        pairs, dictionary.select("token", *KEY), KEY, "inner", "file", dictionary.select(*KEY, "n_docs")
    ).select("token", "file")


def find_original(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Original, kind and scope per token; null for unknown tokens."""
    return by_token(tokens, dictionary.select("token", "original", "kind", "scope"), "left")


def by_token(found: DataFrame, entries: DataFrame, how: str) -> DataFrame:
    """Join by token; one that stands in a large share of all rows is spread by the first other column."""
    found = materialize(found, "found")
    others = [c for c in found.columns if c != "token"]
    if not others:
        return found.join(entries, "token", how)
    joined = lookup(found, entries, ["token"], how, others[0], row_weights(found, ["token"]))
    return joined.select(*found.columns, *[c for c in entries.columns if c != "token" and c in joined.columns])


def forward_map(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("token", "original")


def reverse_map(dictionary: DataFrame) -> DataFrame:
    """One token per original: the last one registered, by number and then by token."""
    return dictionary.groupBy("original").agg(
        F.max_by("token", F.struct("seq", "token")).alias("token")
    )


def summary(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sum("n_docs").cast("bigint").alias("n_docs")
    )


def browse(dictionary: DataFrame) -> DataFrame:
    """Entries by display group, each with the size of its group; ordered, nothing collected."""
    grouped = dictionary.withColumn("category", group_of(F.col("kind")))
    sizes = grouped.groupBy("category").agg(F.count(F.lit(1)).alias("category_size"))
    return (
        grouped.join(F.broadcast(sizes), "category")
        .select(
            group_rank(F.col("category")).alias("category_rank"),
            "category",
            "category_size",
            "token",
            "original",
            F.when(F.col("scope") == "", "(global)").otherwise(F.col("scope")).alias("scope"),
        )
        .orderBy("category_rank", "token")
    )


def tokens_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, n): tokens that stand in a text, counted inside the row."""
    found = F.filter(pieces_of(F.col(text_col), WORD), lambda w: w.rlike(IS_TOKEN))
    return (
        docs.select(id_col, F.explode(found).alias("token"))
        .groupBy(id_col, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_tokens(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """What to show for each token in a text: its entry, or the label of its prefix."""
    label = _mapped(F.substring("token", 1, 2), PREFIX_LABEL, "Unknown")
    return (
        find_original(found, dictionary)
        .withColumn(
            "hover",
            F.when(F.col("original").isNull(), F.concat(F.col("token"), F.lit(" ("), label, F.lit(")")))
            .otherwise(
                F.concat(
                    F.col("token"),
                    F.lit(" → "),
                    F.col("original"),
                    F.lit(" · "),
                    F.col("kind"),
                    F.when(F.col("scope") != "", F.concat(F.lit(" · "), F.col("scope"))).otherwise(F.lit("")),
                )
            ),
        )
        .select(*found.columns, "hover")
    )


def collisions(docs: DataFrame, dictionary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the input that already look like tokens and could be taken for one later."""
    found = tokens_in(docs, id_col, text_col)
    return found if dictionary is None else by_token(found, dictionary.select("token"), "left_semi")


# --- warnings -----------------------------------------------------------------------------


def warnings(symbols: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, type, symbol, detail): symbols whose kind has no prefix of its own."""
    return symbols.where(prefix_of(F.coalesce("kind", F.lit(""))) == OTHER_PREFIX).select(
        id_col,
        F.lit("unknown_kind").alias("type"),
        F.col("name").alias("symbol"),
        F.concat(F.lit("kind "), F.coalesce("kind", F.lit("missing"))).alias("detail"),
    )
