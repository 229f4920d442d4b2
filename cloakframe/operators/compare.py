"""What changed between the text that was sent and the text that came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.arrays import let
from cloakframe.functions.patterns import NAME
from cloakframe.operators.dictionary import tokens_in
from cloakframe.operators.sections import sections_of
from cloakframe.operators.unmask import dependencies_of

# Penalty per kind of change, and the limits of the confidence levels.
PENALTY = {
    "modified": 5,
    "new_variable": 5,
    "new_function": 15,
    "deleted_function": 20,
    "signature_change": 10,
    "new_dependency": 3,
}
HIGH_FROM = 80
MEDIUM_FROM = 50


def _section_keys(docs: DataFrame, language: str, header: str | None, id_col: str, text_col: str) -> DataFrame:
    """(id, name, signature, body hash) with the last section of a name: no body is shuffled."""
    found = docs.select(
        id_col, F.posexplode(sections_of(F.col(text_col), language, header)).alias("nth", "s")
    ).select(
        id_col,
        F.col("s.name").alias("name"),
        "nth",
        F.col("s.signature").alias("signature"),
        F.sha2(F.col("s.body"), 256).alias("body"),
    )
    return found.groupBy(id_col, "name").agg(
        F.max_by("signature", "nth").alias("signature"), F.max_by("body", "nth").alias("body")
    )


def section_changes(
    sent: DataFrame,
    received: DataFrame,
    language: str = "text",
    header: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, type, name): sections that are new, deleted, modified or have another signature."""
    old = _section_keys(sent, language, header, id_col, text_col)
    new = _section_keys(received, language, header, id_col, text_col)
    both = old.withColumnsRenamed({"signature": "old_signature", "body": "old_body"}).join(
        new, [id_col, "name"], "full_outer"
    )
    change = (
        F.when(F.col("old_body").isNull(), "new_function")
        .when(F.col("body").isNull(), "deleted_function")
        .when(F.col("body") == F.col("old_body"), None)
        .when(~F.col("signature").eqNullSafe(F.col("old_signature")), "signature_change")
        .otherwise("modified")
    )
    return both.select(id_col, change.alias("type"), "name").where(F.col("type").isNotNull())


def new_tokens(sent: DataFrame, received: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token) in the received text but not in the one sent."""
    return (
        tokens_in(received, id_col, text_col)
        .select(id_col, "token")
        .join(tokens_in(sent, id_col, text_col).select(id_col, "token"), [id_col, "token"], "left_anti")
    )


def dependency_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        id_col, F.explode(F.array_distinct(dependencies_of(F.col(text_col)))).alias("dependency")
    )


def new_dependencies(sent: DataFrame, received: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return dependency_rows(received, id_col, text_col).join(
        dependency_rows(sent, id_col, text_col), [id_col, "dependency"], "left_anti"
    )


def changes(
    sent: DataFrame,
    received: DataFrame,
    language: str = "text",
    header: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All structural changes as (id, type, name)."""
    variables = new_tokens(sent, received, id_col, text_col).select(
        id_col, F.lit("new_variable").alias("type"), F.col("token").alias("name")
    )
    dependencies = new_dependencies(sent, received, id_col, text_col).select(
        id_col, F.lit("new_dependency").alias("type"), F.col("dependency").alias("name")
    )
    return (
        section_changes(sent, received, language, header, id_col, text_col)
        .unionByName(variables)
        .unionByName(dependencies)
    )


def confidence(received: DataFrame, change_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Score from 100 down to 0 and its level, for every received document."""
    entries = [F.lit(x) for pair in PENALTY.items() for x in pair]
    cost = change_rows.groupBy(id_col).agg(
        F.sum(F.create_map(*entries)[F.col("type")]).alias("_cost"), F.count(F.lit(1)).alias("_n")
    )
    score = F.greatest(F.lit(100) - F.coalesce("_cost", F.lit(0)), F.lit(0)).cast("bigint")
    level = F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")
    return (
        received.select(id_col)
        .join(cost, id_col, "left")
        .select(
            id_col,
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_changes"),
            score.alias("score"),
            level.alias("confidence"),
        )
    )


# --- changed line blocks ------------------------------------------------------------------


def text_lines(text: Column) -> Column:
    """Lines without a last empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    )


def change_blocks(
    sent: DataFrame, received: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Blocks of changed lines: (id, block, start_line, end_line, block_type, original_lines, new_lines).

    A line is unchanged when the same line stands in the other text as often before it, so a line
    that moved counts as unchanged. Blocks at most one line apart are one block. Both texts are
    brought together by one shuffle on the id; every later step keeps that partitioning.
    """
    both = sent.select(id_col, F.col(text_col).alias("_sent")).join(
        received.select(id_col, F.col(text_col).alias("_received")), id_col
    )

    def side(column: str, name: str) -> Column:
        return F.transform(
            text_lines(F.col(column)),
            lambda line, i: F.struct(F.lit(name).alias("side"), i.alias("at"), line.alias("line")),
        )

    rows = both.select(
        id_col, F.explode(F.concat(side("_sent", "old"), side("_received", "new"))).alias("r")
    ).select(id_col, "r.*")
    nth = F.row_number().over(Window.partitionBy(id_col, "line", "side").orderBy("at"))
    pairs = (
        rows.withColumn("nth", nth)
        .groupBy(id_col, "line", "nth")
        .agg(
            F.min(F.when(F.col("side") == "old", F.col("at"))).alias("old_at"),
            F.min(F.when(F.col("side") == "new", F.col("at"))).alias("new_at"),
        )
    )
    # A deleted line stands where the next line after its last unchanged predecessor stands now.
    before = Window.partitionBy(id_col).orderBy("old_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pairs.withColumn(
        "anchor",
        F.coalesce(
            F.col("new_at"),
            F.last(F.when(F.col("old_at").isNotNull(), F.col("new_at")), ignorenulls=True).over(before) + 1,
            F.lit(0),
        ),
    )
    # All windows below share one sort: (id, anchor, width, old_at).
    placed = placed.withColumn("changed", F.col("old_at").isNull() | F.col("new_at").isNull()).withColumn(
        "width", F.when(F.col("new_at").isNull(), 0).otherwise(1)
    )
    w = Window.partitionBy(id_col).orderBy("anchor", "width", "old_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    up_to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    onwards = w.rowsBetween(0, Window.unboundedFollowing)
    end = F.when(F.col("changed"), F.col("anchor") + F.col("width"))
    opens = F.col("changed") & (F.col("anchor") - F.coalesce("_reach", F.lit(-2)) > 1)
    marked = (
        placed.withColumn("_end", end)
        .withColumn("_reach", F.max("_end").over(so_far))
        .withColumn("_opens", F.when(opens, 1).otherwise(0))
        .withColumn("block", F.sum("_opens").over(up_to_here))
        .withColumn("_own", F.when(F.col("changed"), F.col("block")))
        .withColumn("_next", F.first("_own", ignorenulls=True).over(onwards))
        .where((F.col("block") > 0) & F.col("block").eqNullSafe(F.col("_next")))
    )

    def in_order(condition: Column, at: str) -> Column:
        kept = F.collect_list(F.when(condition, F.struct(F.col(at).alias("at"), F.col("line").alias("line"))))
        return F.transform(F.array_sort(kept), lambda x: x["line"])

    grouped = marked.groupBy(id_col, "block").agg(
        F.min(F.when(F.col("changed"), F.col("anchor"))).cast("bigint").alias("start_line"),
        F.max("_end").cast("bigint").alias("end_line"),
        F.count_if(F.col("changed") & F.col("new_at").isNull()).alias("_deleted"),
        F.count_if(F.col("changed") & F.col("new_at").isNotNull()).alias("_added"),
        F.count_if(~F.col("changed")).alias("_between"),
        in_order(F.col("old_at").isNotNull(), "old_at").alias("original_lines"),
        in_order(F.col("new_at").isNotNull(), "new_at").alias("new_lines"),
    )
    kind = (
        F.when(F.col("_deleted") == 0, "added")
        .when((F.col("_added") == 0) & (F.col("_between") == 0), "deleted")
        .otherwise("modified")
    )
    return grouped.select(
        id_col,
        F.col("block").cast("bigint").alias("block"),
        "start_line",
        "end_line",
        kind.alias("block_type"),
        # Lines between two additions belong to the block, but nothing was there to be changed.
        F.when(kind == "added", F.array().cast("array<string>")).otherwise(F.col("original_lines")).alias(
            "original_lines"
        ),
        "new_lines",
    )


_IMPORT = r"^(?:import |from |#include)"
_TRY = r"try:|try \{"
_IF = r"^if[ (]"
_CPP_FUNCTION = rf"^(?:[\p{{L}}\p{{N}}_:*&<>, ]+\s+)?({NAME})\s*\([^)]*\)\s*\{{"


def describe_change(original: Column, new: Column) -> Column:
    """A short description of a block, by the first rule that fits."""
    clean = lambda lines: F.filter(
        F.transform(lines, lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")), lambda line: line != ""
    )

    def any_like(lines: Column, pattern: str) -> Column:
        return F.exists(lines, lambda line: line.rlike(pattern))

    def first_function(lines: Column, with_cpp: bool) -> Column:
        def name(line: Column) -> Column:
            found = F.when(line.rlike(rf"^def\s+{NAME}\s*\("), F.regexp_extract(line, rf"^def\s+({NAME})", 1))
            if with_cpp:
                cpp = F.regexp_extract(line, _CPP_FUNCTION, 1)
                found = found.when((cpp != "") & ~cpp.isin("if", "for", "while", "switch", "catch"), cpp)
            return found

        return F.get(F.filter(F.transform(lines, name), lambda n: n.isNotNull()), F.lit(0))

    def addition(n: Column) -> Column:
        function = first_function(n, True)
        return (
            F.when(function.isNotNull(), F.concat(F.lit("new helper function '"), function, F.lit("'")))
            .when(
                F.forall(n, lambda line: line.rlike(_IMPORT)),
                F.concat(F.lit("added dependency: "), F.array_join(n, ", ")),
            )
            .when(any_like(n, _TRY), F.lit("error handling"))
            .when(any_like(n, r"\.get\(|is None|is not None"), F.lit("null-safety check"))
            .when(any_like(n, _IF), F.lit("added conditional check"))
            .otherwise(F.concat(F.lit("added "), F.size(new).cast("string"), F.lit(" lines")))
        )

    def operator_change(o: Column, n: Column) -> Column:
        a, b = F.get(o, F.lit(0)), F.get(n, F.lit(0))
        differing = F.filter(
            F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda p: p["a"] != p["b"]
        )
        one = F.get(differing, F.lit(0))
        operators = r"^[-+*/%<>=!&|^]$"
        return F.when(
            (F.size(o) == 1)
            & (F.size(n) == 1)
            & (F.length(a) == F.length(b))
            & (F.size(differing) == 1)
            & (one["a"].rlike(operators) | one["b"].rlike(operators)),
            F.concat(F.lit("changed '"), one["a"], F.lit("' to '"), one["b"], F.lit("'")),
        )

    def modification(o: Column, n: Column) -> Column:
        introduced = lambda pattern: any_like(n, pattern) & ~any_like(o, pattern)
        function = first_function(
            F.filter(
                n,
                lambda line: ~F.exists(
                    o, lambda old: F.contains(old, F.regexp_extract(line, rf"^def\s+({NAME})\s*\(", 1))
                    & line.rlike(r"^def\s")
                ),
            ),
            False,
        )
        imports = F.array_sort(
            F.array_distinct(
                F.array_except(
                    F.filter(n, lambda line: line.rlike(_IMPORT)), F.filter(o, lambda line: line.rlike(_IMPORT))
                )
            )
        )
        return (
            F.when(introduced(r"\.get\("), F.lit("null-safety check with .get()"))
            .when(introduced(_TRY), F.lit("error handling"))
            .when(introduced(_IF), F.lit("wrapped in conditional check"))
            .when(operator_change(o, n).isNotNull(), operator_change(o, n))
            .when(function.isNotNull(), F.concat(F.lit("new helper function '"), function, F.lit("'")))
            .when(F.size(imports) > 0, F.concat(F.lit("added dependency: "), F.array_join(imports, ", ")))
            .otherwise(F.concat(F.lit("modified "), F.size(new).cast("string"), F.lit(" lines")))
        )

    return (
        F.when(F.size(original) == 0, addition(clean(new)))
        .when(F.size(new) == 0, F.concat(F.lit("removed "), F.size(original).cast("string"), F.lit(" lines")))
        .otherwise(modification(clean(original), clean(new)))
    )


def comment_mark(text: Column) -> Column:
    """``//`` or ``#``: the style of the first comment line, else of what the code looks like."""
    marks = F.filter(
        F.transform(
            F.split(text, "\n", -1),
            lambda line: F.when(line.rlike(r"^\s*//"), "//").when(line.rlike(r"^\s*#(?!include)"), "#"),
        ),
        lambda m: m.isNotNull(),
    )
    return F.coalesce(
        F.get(marks, F.lit(0)),
        F.when(text.contains("def ") | text.contains("import "), "#").when(
            text.contains("#include") | text.contains("int main") | text.contains("::"), "//"
        ),
        F.lit("#"),
    )


def annotate_changes(
    received: DataFrame, blocks: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The received text with a comment above each changed block that says what happened there."""
    label = (
        F.when(F.col("block_type") == "added", "AI ADDED")
        .when(F.col("block_type") == "deleted", "AI REMOVED")
        .otherwise("AI MODIFIED")
    )
    notes = blocks.groupBy(id_col).agg(
        F.collect_list(
            F.struct(
                F.col("start_line").cast("int").alias("at"),
                F.concat(
                    F.lit(" --- "), label, F.lit(": "), describe_change(F.col("original_lines"), F.col("new_lines")), F.lit(" ---")
                ).alias("note"),
            )
        ).alias("_notes")
    )
    row = "array<struct<at:int,rank:int,line:string>>"

    def merged(lines: Column, mark: Column) -> Column:
        own = F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.lit(1).alias("rank"), line.alias("line")))
        added = F.transform(
            F.col("_notes"),
            lambda n: F.struct(
                n["at"].alias("at"),
                F.lit(0).alias("rank"),
                F.concat(
                    F.coalesce(
                        F.when(
                            F.get(lines, n["at"]).rlike(r"\S"),
                            F.repeat(F.lit(" "), F.length(F.regexp_extract(F.get(lines, n["at"]), r"^(\s*)", 1))),
                        ),
                        F.lit(""),
                    ),
                    mark,
                    n["note"],
                ).alias("line"),
            ),
        )
        return F.array_join(
            F.transform(F.array_sort(F.concat(own.cast(row), added.cast(row))), lambda x: x["line"]), "\n"
        )

    text = F.col(text_col)
    others = [c for c in received.columns if c != text_col]
    return received.join(notes, id_col, "left").select(
        *others,
        F.when(F.col("_notes").isNull(), text)
        .otherwise(let(text_lines(text), lambda lines: let(comment_mark(text), lambda mark: merged(lines, mark))))
        .alias(text_col),
    )
