"""Rewriting of text columns: names, comments, bounds and selected spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import fill, fill_known, groups, let, pieces_of
from cloakframe.functions.patterns import COMMENTS, FORMAT_SPEC, SCAN, STRINGS
from cloakframe.operators.extract import is_user_name
from cloakframe.operators.lookups import frequent_entries, in_row_table, lookup, lookup_stored, with_table


def substitute(
    docs: DataFrame,
    resolved: DataFrame,
    pattern: str | Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    count_as: str | None = None,
) -> DataFrame:
    """Rewrite each text: ``resolved`` has (id, value, at) for the pieces to replace.

    ``pattern`` cuts the texts, or is a function that gives the filled text of ``_filled`` (where rows differ).

    Only positions and tokens are regrouped; the text itself is shuffled once, for the join by id,
    and not at all where the documents are bucketed by id. The list collected per id is no longer
    than the text of that row.
    """
    filled = resolved.repartition(id_col).groupBy(id_col).agg(F.collect_list(F.struct("value", "at")).alias("_filled"))
    joined = docs.join(filled, id_col, "left")
    others = [c for c in docs.columns if c != text_col]
    filling = fill(F.col(text_col), pattern, F.col("_filled")) if isinstance(pattern, str) else pattern(F.col("_filled"))
    columns = [*others, filling.alias(text_col)]
    if count_as:
        columns.append(F.greatest(F.coalesce(F.size("_filled"), F.lit(0)), F.lit(0)).cast("bigint").alias(count_as))
    return joined.select(*columns)


def resolve(
    symbols: DataFrame,
    dictionary: DataFrame,
    id_col: str = "doc_id",
    weights: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """The token of every symbol row (id, name, kind, scope, …).

    Names are as uneven as words are: those found in a large share of all documents are spread over
    several partitions. Their counts are those of the dictionary, or ``weights`` (kind, scope, name,
    n_docs) where the dictionary's are not of these symbols. ``stored``: the symbols are a written
    table, which is read twice so that only rows of rare names are shuffled.
    """
    keys = ["kind", "scope", "name"]
    entries = dictionary.select("kind", "scope", F.col("original").alias("name"), "token", "n_docs")
    counts = entries.drop("token") if weights is None else weights
    if stored:
        return lookup_stored(symbols, entries.drop("n_docs"), keys, counts)
    return lookup(symbols, entries.drop("n_docs"), keys, "inner", id_col, counts)


def rename(
    docs: DataFrame,
    symbols: DataFrame,
    dictionary: DataFrame,
    language: str = "prose",
    id_col: str = "doc_id",
    text_col: str = "text",
    count_as: str | None = None,
    weights: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """Replace every bound occurrence of a symbol by its token."""
    resolved = resolve(symbols, dictionary, id_col, weights, stored).select(id_col, F.col("token").alias("value"), "at")
    return substitute(docs, resolved, SCAN[language], id_col, text_col, count_as)


def rename_all(
    docs: DataFrame,
    symbols: DataFrame,
    dictionary: DataFrame,
    language: str = "prose",
    id_col: str = "doc_id",
    text_col: str = "text",
    count_as: str | None = None,
) -> DataFrame:
    """``rename`` of running text whose names are all bound: the stored ``symbols`` are those of ``extract.symbols``.

    Such a name has one token wherever it stands. Frequent names, by Zipf's law most of all rows, are looked up inside the
    row of the text; only rows of the others are shuffled to the dictionary and back to the texts.
    """
    entries = dictionary.where("kind = 'variable' AND scope = ''").where(is_user_name(F.col("original"), language))
    frequent = frequent_entries(entries, F.col("original"), F.col("token"))
    names = F.broadcast(frequent.select(F.col("key").alias("name")))
    others = resolve(symbols.join(names, "name", "left_anti"), dictionary, id_col)
    parts = others.select(id_col, F.col("token").alias("value"), "at", F.lit(None).cast("bigint").alias("n"))
    if count_as:
        counts = symbols.join(names, "name", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
        none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in ("value", "at")]
        parts = parts.unionByName(counts.select(id_col, "n", *none))
    filled = parts.repartition(id_col).groupBy(id_col).agg(
        F.collect_list(F.when(F.col("n").isNull(), F.struct("value", "at"))).alias("_filled"),
        (F.count("value") + F.coalesce(F.sum("n"), F.lit(0))).alias("_n"),
    )
    joined = with_table(docs.join(filled, id_col, "left"), in_row_table(frequent))
    text = F.col(text_col)
    done = F.when(F.col(id_col).isNull(), text).otherwise(fill_known(text, SCAN[language], F.col("_filled"), F.col("_table")))
    columns = [*[c for c in docs.columns if c != text_col], done.alias(text_col)]
    if count_as:
        columns.append(F.coalesce("_n", F.lit(0)).cast("bigint").alias(count_as))
    return joined.select(*columns)


def mask_span(text: Column, start: Column, length: Column, transform) -> Column:
    """Apply ``transform`` to ``length`` characters from ``start`` (1-based) and keep the rest."""
    head = F.substring(text, F.lit(1), start - 1)
    middle = F.substring(text, start, length)
    tail = F.substring(text, start + length, F.length(text))
    return F.concat(head, transform(middle), tail)


def _outside_strings(language: str, comment: str) -> str:
    """Strings in group 1; whole-line comments with their line; other comments with space before."""
    lead = r"(?<![ \t])[ \t]*+"
    one = f"(?:{comment})"
    return (
        f"({STRINGS[language]})"
        rf"|(?m:^)[ \t]*+{one}(?:[ \t]*+{one})*+(?:[ \t]*+\n)?"
        rf"|{lead}{one}"
    )


def strip_comments(text: Column, language: str) -> Column:
    """Delete comments: a comment alone on its line takes the line with it."""
    bare = F.regexp_replace(text, _outside_strings(language, COMMENTS[language]), "$1")
    if language != "python":
        return bare
    docstring = r"(\A\s*|:[ \t]*\n(?:[ \t]*\n)*+)[ \t]*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')[ \t]*(?:\n(?:[ \t]*\n)?)?"
    return F.regexp_replace(bare, docstring, "$1")


def _comment_text(text: Column, language: str) -> Column:
    """A line break in front lets a docstring be told from a string in an expression."""
    return F.concat(F.lit("\n"), text) if language == "python" else text


def _comment_pattern(language: str) -> str:
    """Strings are passed over; in Python a triple-quoted string that starts its line is a comment.

    The forms are tried only at characters that one of them starts with.
    """
    plain = f"{STRINGS[language]}|{COMMENTS[language]}"
    if language == "python":
        plain = rf"\n[ \t]*+(?:\"\"\"[\s\S]*?\"\"\"|\'\'\'[\s\S]*?\'\'\')|{plain}"
    return rf"(?=[\"'#/<\n])(?:{plain})"


def _is_comment(piece: Column, language: str) -> Column:
    return piece.rlike(r"^[#\n]" if language == "python" else f"^(?:{COMMENTS[language]})")


def _wrapped(piece: Column, token: Column) -> Column:
    """The placeholder in the syntax of the comment it stands for."""
    return (
        F.when(piece.startswith('"""'), F.concat(F.lit('"""'), token, F.lit('"""')))
        .when(piece.startswith("'''"), F.concat(F.lit("'''"), token, F.lit("'''")))
        .when(piece.startswith("//"), F.concat(F.lit("// "), token))
        .when(piece.startswith("/*"), F.concat(F.lit("/* "), token, F.lit(" */")))
        .when(piece.startswith("<!--"), F.concat(F.lit("<!-- "), token, F.lit(" -->")))
        .otherwise(F.concat(F.lit("# "), token))
    )


def numbered_comments(text: Column, language: str) -> Column:
    """array<struct<at, token, lead, comment>>: comments numbered from the last one to the first."""
    pattern = _comment_pattern(language)
    kept = F.filter(
        F.transform(
            pieces_of(_comment_text(text, language), pattern),
            lambda p, i: F.struct(i.alias("at"), p.alias("piece")),
        ),
        lambda c: _is_comment(c["piece"], language),
    )
    return let(
        kept,
        lambda all_: F.transform(
            all_,
            lambda c, i: F.struct(
                c["at"].alias("at"),
                F.format_string("[gk_%03d]", F.size(all_) - i).alias("token"),
                F.regexp_extract(c["piece"], r"^(\n[ \t]*)?", 0).alias("lead"),
                F.regexp_replace(c["piece"], r"^\n[ \t]*", "").alias("comment"),
            ),
        ),
    )


def comment_store(docs: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, original): what the placeholders of a document stand for."""
    return docs.select(id_col, F.explode(numbered_comments(F.col(text_col), language)).alias("c")).select(
        id_col, F.col("c.token").alias("token"), F.col("c.comment").alias("original")
    )


def placeholder_comments(text: Column, language: str) -> Column:
    """The text with each comment replaced by its numbered placeholder."""
    filled = F.transform(
        numbered_comments(text, language),
        lambda c: F.struct(
            F.concat(c["lead"], _wrapped(c["comment"], c["token"])).alias("value"),
            F.array(c["at"]).alias("at"),
        ),
    )
    done = fill(_comment_text(text, language), _comment_pattern(language), filled)
    return F.substring(done, 2, 2147483647) if language == "python" else done


# Loop bounds: the number in "for (…; i < N;" and in "range(N)".
_FOR_BOUND = r"(?<![\p{L}\p{N}_])for\s*+\([^;]*+;\s*+[\p{L}\p{N}_]++\s*+[<>!=]++\s*+[0-9]++(?=\s*+;)"
_RANGE_BOUND = r"range\s*+\([0-9]++(?=\s*+\))"
BOUND = f"{_FOR_BOUND}|{_RANGE_BOUND}"
ANY_NUMBER = r"(?<![\p{L}\p{N}_.])[0-9]+(?![\p{L}\p{N}_.])"


def _bound_digits(piece: Column) -> Column:
    return F.regexp_extract(piece, r"([0-9]+)$", 1)


def bounds(docs: DataFrame, pattern: str = BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers above 1 at the end of a matched piece, as constants of scope ``loop_bound``."""
    found = groups(
        pieces_of(F.col(text_col), pattern),
        lambda p: F.length(F.ltrim(F.translate(_bound_digits(p), "0", " "))) > 0,
    )
    rows = docs.select(id_col, F.explode(found).alias("s")).select(
        id_col,
        _bound_digits(F.col("s.key")).alias("name"),
        F.lit("constant").alias("kind"),
        F.lit("loop_bound").alias("scope"),
        F.regexp_extract("s.key", r"^([\s\S]*?)[0-9]+$", 1).alias("lead"),
        F.col("s.at").alias("at"),
    )
    return rows.where(F.regexp_replace("name", "^0+", "") != "1")


def generalize_bounds(
    docs: DataFrame,
    found: DataFrame,
    dictionary: DataFrame,
    pattern: str = BOUND,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Replace loop bounds by constant tokens; the text before the number stays."""
    resolved = resolve(found, dictionary, id_col).select(id_col, F.concat("lead", "token").alias("value"), "at")
    return substitute(docs, resolved, pattern, id_col, text_col)


def keep_format(text: Column) -> Column:
    """Only the format specifiers and escapes of a format string, in quotes."""
    kept = F.array_join(pieces_of(F.btrim(text, F.lit('"')), FORMAT_SPEC), " ")
    return F.concat(F.lit('"'), kept, F.lit('"'))


def comment_count(text: Column, language: str) -> Column:
    return F.size(numbered_comments(text, language)).cast("bigint")

