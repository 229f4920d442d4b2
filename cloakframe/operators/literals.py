"""String and number literals: extraction, the scrub / keep / flag decision, and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind, gaps_of, let, line_widths, pieces_of, runs, sql_let, sql_located
from cloakframe.functions.patterns import (
    COMMON_FLOATS,
    DOMAIN_MARKS,
    LITERAL,
    LITERAL_MARK,
    MATH_CONSTANTS,
    PRINT_CALLS,
    WORD,
)
from cloakframe.operators.lookups import heavy_keys, lookup, row_weights
from cloakframe.operators.masking import resolve, substitute
from cloakframe.operators.substrings import GRAM, contained_names, string_id
from cloakframe.operators.substrings import ID as STRING_ID
from cloakframe.session import COMPACT, materialize

LITERALS = (
    "array<struct<value:string,kind:string,at:int,offset:int,end_offset:int,line:int,"
    "action:string,reason:string,context:string>>"
)
_LOOK_BACK = 80
_LOOK_AHEAD = 20


def _choose(*cases: tuple[Column, Column | str], other: Column | str) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    choice = as_column(other)
    for condition, value in reversed(cases):
        choice = F.when(condition, as_column(value)).otherwise(choice)
    return choice


def _decision(action: str, reason: Column | str, context: Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(action).alias("action"), reason.alias("reason"), context.alias("context"))


def _first(cases: list[tuple[Column, str, Column | str, Column]], other: Column) -> Column:
    """The decision of the first case whose condition holds; a condition that is null does not."""
    choice = other
    for condition, action, reason, context in reversed(cases):
        choice = F.when(condition, _decision(action, reason, context)).otherwise(choice)
    return choice


def string_context(before: Column) -> Column:
    """``printf`` after a print or log call or a stream operator, else ``other``."""
    stripped = F.regexp_replace(before, r"\s+\z", "")

    def decide(s: Column) -> Column:
        call = F.regexp_extract(s, r"([\p{L}\p{N}_]+)\s*\([^)]*\z", 1)
        printing = s.contains("(") & let(call, lambda c: c.isin(PRINT_CALLS) | c.rlike("(?i)log|print"))
        return _choose((printing | F.right(s, F.lit(30)).contains("<<"), "printf"), other="other")

    return let(stripped, decide)


def classify_string(value: Column, context: Column, included: Column, known: Column) -> Column:
    """struct<action, reason, context>; ``known`` is a known name inside the string, or null. ``context`` is read once."""
    return let(context, lambda bound: _string_decision(value, bound, included, known))


def _string_decision(value: Column, context: Column, included: Column, known: Column) -> Column:
    size = F.length(value)
    none = F.lit("")
    return _first(
        [
            (size <= 1, "keep", "trivial string", none),
            (included, "keep", "include directive", none),
            (value.rlike(DOMAIN_MARKS), "scrub", "domain indicator detected", context),
            (known.isNotNull(), "scrub", F.concat(F.lit("contains symbol name '"), known, F.lit("'")), context),
            (context == "printf", "scrub", "log/print string (business context)", context),
            (size > 20, "scrub", "long descriptive string", context),
            (size > 5, "flag", "medium-length string (review recommended)", context),
        ],
        _decision("keep", "short string", context),
    )


def number_context(looped: Column, around: Column) -> Column:
    return _choose(
        (looped, "loop_bound"),
        (around.rlike(r"[<>]|==|!="), "comparison"),
        (around.rlike(r"[*/+%-]"), "arithmetic"),
        other="assignment",
    )


def classify_number(value: Column, context: Column) -> Column:
    """struct<action, reason, context> of a number as it is written."""
    raw = F.regexp_replace(value, "[fFlLuU]+$", "")

    def decide(r: Column) -> Column:
        hexadecimal = r.rlike("^0[xX]")
        floating = ~hexadecimal & r.rlike("[.eE]")
        digits = F.regexp_replace(F.regexp_replace(r, "^0[xX]", ""), "^0+(?=.)", "")
        real = F.when(floating, r.try_cast("double"))
        # Integers have no upper bound here: more than three digits is above 100 in any case.
        whole = F.when(
            ~hexadecimal & ~floating, F.when(F.length(digits) > 3, F.lit(1000)).otherwise(digits.try_cast("int"))
        )
        known = F.coalesce(
            *[F.when(F.abs(real - F.lit(v)) < 1e-6, F.lit(name)) for v, name in MATH_CONSTANTS]
        )
        none = F.lit("")
        return _first(
            [
                (hexadecimal & (F.length(r) <= 2), "keep", "unparseable literal", none),
                (~floating & digits.isin("0", "1", "2"), "keep", "generic integer", none),
                (known.isNotNull(), "keep", F.concat(F.lit("known constant ("), known, F.lit(")")), none),
                (real.isin(COMMON_FLOATS), "keep", "common float default", none),
                (hexadecimal, "scrub", "hex literal (potentially domain-specific)", context),
                (whole > 100, "flag", "large integer (review recommended)", context),
                ((whole >= 3) & (context == "loop_bound"), "flag", "loop bound dimension", context),
                (whole >= 3, "keep", "small integer", context),
                (floating, "flag", "non-trivial float (review recommended)", context),
            ],
            _decision("keep", "generic value", context),
        )

    return let(raw, decide)


def _with_surroundings(listed: bool, given: bool) -> str:
    """SQL body: every literal with its place, what stands around it, and its line's marks.

    Known names come from a list (``s.names``), from rows per string (``s.known``), or are not asked for.

    The 80 characters before and the 20 from a literal on are put together from at most as many
    neighbouring pieces, so a literal costs the same wherever it stands in the text.
    """
    tails = f"zip_with(slice(s.g, 1, size(s.p)), s.p, (g, p) -> right(concat(g, p), {_LOOK_BACK}))"
    heads = f"zip_with(s.p, slice(s.g, 2, size(s.p)), (p, g) -> left(concat(p, g), {_LOOK_AHEAD}))"
    earlier = f"greatest(i - {_LOOK_BACK}, 0)"
    before = (
        f"right(CASE WHEN length(s.g[i]) >= {_LOOK_BACK} THEN s.g[i] ELSE "
        f"concat(array_join(slice(k.tails, {earlier} + 1, i - {earlier}), ''), s.g[i]) END, {_LOOK_BACK})"
    )
    after = f"left(array_join(slice(k.heads, i + 1, {_LOOK_AHEAD}), ''), {_LOOK_AHEAD})"
    # One name or null per piece up to the last one that has a name.
    dense = (
        "flatten(transform(s.known, (x, i) -> concat(array_repeat(cast(null AS string), "
        "x.at - coalesce(get(s.known, i - 1).at, -1) - 1), array(x.name))))"
    )
    first = (
        "CASE WHEN left(piece, 1) = '\"' THEN "
        "array_min(filter(s.names, n -> length(n) > 2 AND contains(btrim(piece, '\"'), n))) END"
    )
    cases = ["get(k.known, i)"] * given + [first] * listed + ["cast(null AS string)"]
    known = f"coalesce({', '.join(cases)})"
    rows = sql_located(
        f", 'before', {before}, 'after', {after}, 'known', {known}, 'marks', s.marks[c.n[i] - 1]"
    )
    more = f", 'known', {dense}" if given else ""
    return sql_let(f"named_struct('tails', {tails}, 'heads', {heads}{more})", "k", rows)


def strings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, piece): the quoted strings of each text with their place among its literals."""
    return docs.select(id_col, F.posexplode(pieces_of(F.col(text_col), LITERAL)).alias("at", "piece")).where(
        F.col("piece").startswith('"')
    )


def _words_in_strings(strings: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    words = F.array_distinct(pieces_of(F.col("piece"), WORD))
    held = strings.select(id_col, "at", F.explode(words).alias("name")).where(F.length("name") > 2)
    held = materialize(held, "string-words", COMPACT)
    return lookup(held, names.select("name").distinct(), ["name"], "inner", id_col, heavy_keys(held, ["name"]))


def _parts_of_strings(strings: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    value = F.btrim("piece", F.lit('"'))
    held = strings.select(id_col, "at", *string_id(value), value.alias("value")).where(F.length("value") >= GRAM)
    held = materialize(held, "strings")
    distinct = held.groupBy(*STRING_ID).agg(F.first("value").alias("value"))
    named = contained_names(distinct, names).groupBy(*STRING_ID).agg(F.min("name").alias("name"))
    places = held.select(id_col, "at", *STRING_ID)
    return lookup(places, named, STRING_ID, "inner", id_col, row_weights(places, STRING_ID)).select(id_col, "at", "name")


def names_in_strings(
    docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: str = "word"
) -> DataFrame:
    """(id, known): for each string that holds one of ``names`` (name) its place and the first such name.

    ``within`` is ``word`` (a name is a whole word of the string) or ``substring`` (it may stand inside a word).
    Names of two letters or less don't count. What is collected per document are its own strings.
    """
    strings = strings_of(docs, id_col, text_col)
    found = (_words_in_strings if within == "word" else _parts_of_strings)(strings, names, id_col)
    return (
        found.groupBy(id_col, "at")
        .agg(F.min("name").alias("name"))
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("known"))
    )


def literals_of(text: Column, names: Column | None = None, known: Column | None = None) -> Column:
    """All literals of a text with their decision.

    array<struct<value, kind, at, offset, end_offset, line, action, reason, context>>. A string that
    contains one of ``names`` (a short list) is scrubbed, and so is one that ``known`` (from
    ``names_in_strings``) gives a name for.
    """
    marks = F.transform(
        F.split(text, "\n", -1),
        lambda line: F.struct(
            line.rlike(r"^\s*for").alias("looped"),
            line.rlike(r"^\s*#include").alias("included"),
            F.instr(line, "for (").alias("for_at"),
        ),
    )
    bound = {"g": gaps_of(text, LITERAL), "p": pieces_of(text, LITERAL), "l": line_widths(text), "marks": marks}
    if names is not None:
        bound["names"] = names
    if known is not None:
        bound["known"] = F.coalesce(known, F.array()).cast("array<struct<at:int,name:string>>")
    places = bind(_with_surroundings(names is not None, known is not None), **bound)

    def decided(o: Column) -> Column:
        marks = o["marks"]
        looped = marks["looped"] | ((marks["for_at"] > 0) & (marks["for_at"] + 4 <= o["col"] - 1))
        quoted = o["piece"].startswith('"')
        text_case = classify_string(
            F.btrim(o["piece"], F.lit('"')), string_context(o["before"]), marks["included"], o["known"]
        )
        number_case = classify_number(
            o["piece"], number_context(looped, F.concat(F.right(o["before"], F.lit(10)), o["after"]))
        )
        return let(
            F.when(quoted, text_case).otherwise(number_case),
            lambda d: F.struct(
                o["piece"].alias("value"),
                F.when(quoted, "string").otherwise("number").alias("kind"),
                *[o[f].alias(f) for f in ("at", "offset", "end_offset", "line")],
                *[d[f].alias(f) for f in ("action", "reason", "context")],
            ),
        )

    none = F.array().cast(LITERALS)
    return F.when(~text.rlike(LITERAL_MARK), none).otherwise(F.transform(places, decided))


def literals(docs: DataFrame, names: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per literal."""
    found = docs.select(id_col, F.explode(literals_of(F.col(text_col), names)).alias("l"))
    return found.select(
        id_col,
        "l.value",
        "l.kind",
        F.col("l.offset").cast("bigint").alias("offset"),
        F.col("l.end_offset").cast("bigint").alias("end_offset"),
        F.col("l.line").cast("bigint").alias("line"),
        "l.action",
        "l.reason",
        "l.context",
        F.col("l.at").alias("at"),
    )


def literal_arrays(
    docs: DataFrame,
    names: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: Column | None = None,
) -> DataFrame:
    """(id, literals): all literals of a document in one array, to be stored and used more than once."""
    return docs.select(id_col, literals_of(F.col(text_col), names, known).alias("literals"))


def _with_action(action: str) -> Column:
    return F.filter("literals", lambda x: x["action"] == action)


def literal_counts(arrays: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: n_scrub, n_keep, n_flag."""
    return arrays.select(
        id_col, *[F.size(_with_action(a)).cast("bigint").alias(f"n_{a}") for a in ("scrub", "keep", "flag")]
    )


def literal_summary(arrays: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: counts by action, the first ten kept values, and every flagged value with its line."""
    return arrays.select(
        id_col,
        F.size(_with_action("scrub")).cast("bigint").alias("n_scrub"),
        F.size(_with_action("keep")).cast("bigint").alias("n_keep"),
        F.size(_with_action("flag")).cast("bigint").alias("n_flag"),
        F.array_join(F.transform(F.slice(_with_action("keep"), 1, 10), lambda x: x["value"]), ", ").alias("kept_sample"),
        F.array_join(
            F.transform(
                _with_action("flag"),
                lambda x: F.concat(x["line"].cast("string"), F.lit(": "), x["value"], F.lit(" - "), x["reason"]),
            ),
            "\n",
        ).alias("flagged"),
    )


def scrubbed_symbols(arrays: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Literals to scrub as symbols: (id, name, kind, scope, at), strings without the quotes around them."""
    keyed = F.transform(
        _with_action("scrub"),
        lambda x: F.struct(
            F.when(x["kind"] == "string", "string").otherwise("constant").alias("kind"),
            F.when(x["kind"] == "string", F.substring(x["value"], F.lit(2), F.length(x["value"]) - 2))
            .otherwise(x["value"])
            .alias("name"),
            x["at"].alias("at"),
        ),
    )
    grouped = F.transform(
        runs(F.sort_array(keyed), "kind", "name"),
        lambda run: F.struct(
            F.get(run, F.lit(0))["name"].alias("name"),
            F.get(run, F.lit(0))["kind"].alias("kind"),
            F.lit("").alias("scope"),
            F.transform(run, lambda s: s["at"]).alias("at"),
        ),
    )
    return arrays.select(id_col, F.explode(grouped).alias("s")).select(id_col, "s.*")


def mask_literals(
    docs: DataFrame,
    scrubbed: DataFrame,
    dictionary: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Put tokens in place of the scrubbed literals; strings keep their quotes."""
    resolved = resolve(scrubbed, dictionary, id_col).select(
        id_col,
        F.when(F.col("kind") == "string", F.concat(F.lit('"'), "token", F.lit('"')))
        .otherwise(F.col("token"))
        .alias("value"),
        "at",
    )
    return substitute(docs, resolved, LITERAL, id_col, text_col)
