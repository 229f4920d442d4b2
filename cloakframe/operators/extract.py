"""Names in text: every occurrence, the declared symbols, comments, imports and calls.

All of it is work inside a row. A *binding* is array<struct<name, kind, scope, at>>: each symbol of
a document with the places where it stands among the pieces of the scan pattern.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import firsts, gaps_of, groups, let, located, pieces_of, runs, weave
from cloakframe.functions.names import protected_names
from cloakframe.functions.patterns import (
    COMMENTS,
    DOCSTRING_LEAD,
    IS_NAME,
    NAME,
    PERSONAL_DATA,
    SCAN,
    STRINGS,
    Rule,
)
from cloakframe.operators.cpp_scopes import SYMBOLS, cpp_declared

BINDING = "array<struct<name:string,kind:string,scope:string,at:array<int>>>"


def is_user_name(name: Column, language: str, imported: Column | None = None) -> Column:
    """True for names that may be masked (no keyword, built-in, dunder, lone underscore, import)."""
    ok = (
        name.rlike(IS_NAME)
        & ~name.isin(protected_names(language))
        & ~(name.startswith("__") & name.rlike("^__.*__$"))
        & (name != "_")
    )
    return ok if imported is None else ok & ~F.array_contains(imported, name)


def occurrences(docs: DataFrame, language: str = "prose", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence of a name, with offsets from 0 and line and column from 1."""
    found = F.filter(
        located(F.col(text_col), SCAN[language]), lambda o: is_user_name(o["piece"], language)
    )
    return docs.select(id_col, F.explode(found).alias("o")).select(
        id_col,
        F.col("o.piece").alias("name"),
        F.col("o.line").cast("bigint").alias("line"),
        F.col("o.col").cast("bigint").alias("col"),
        F.col("o.offset").cast("bigint").alias("offset"),
        F.col("o.end_offset").cast("bigint").alias("end_offset"),
    )


def imported_names(text: Column) -> Column:
    """Names brought in by import lines, and the top-level modules they come from."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"^\s*(?:import|from)\s"))

    def names(line: Column) -> Column:
        module = F.regexp_extract(line, rf"^\s*from\s+({NAME})", 1)
        listed = F.regexp_replace(
            F.regexp_replace(line, r"^\s*(?:from\s+\S+\s+)?import\s+", ""), r"[()]|#.*$", ""
        )
        parts = F.split(listed, ",", -1)
        used = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^.*\sas\s+", "")))
        tops = F.when(
            line.rlike(r"^\s*import\s"),
            F.transform(parts, lambda p: F.regexp_extract(p, rf"^\s*({NAME})", 1)),
        ).otherwise(F.array(module))
        return F.concat(used, tops)

    return F.array_distinct(
        F.filter(F.flatten(F.transform(lines, names)), lambda n: n.rlike(rf"^{NAME}(?:\.{NAME})*$"))
    )


def prose_symbols(text: Column, scan: str = "prose") -> Column:
    """Every name of running text is one symbol; no declaration is needed."""
    return F.transform(
        groups(pieces_of(text, SCAN[scan]), lambda p: is_user_name(p, scan)),
        lambda s: F.struct(
            s["key"].alias("name"),
            F.lit("variable").alias("kind"),
            F.lit("").alias("scope"),
            s["at"].alias("at"),
        ),
    ).cast(BINDING)


def rule_pattern(rules: list[Rule] = PERSONAL_DATA) -> str:
    return "|".join(f"(?:{r.pattern})" for r in rules)


def rule_pieces(text: Column, rules: list[Rule] = PERSONAL_DATA) -> Column:
    """The pieces of ``rule_pattern``; a text is searched only for the rules whose mark it holds, if any of them."""
    plain = [r for r in rules if not r.mark]
    if not plain or len(plain) == len(rules):
        return pieces_of(text, rule_pattern(rules))
    marked = reduce(or_, [text.contains(m) for m in dict.fromkeys(r.mark for r in rules if r.mark)])
    return F.when(~marked, pieces_of(text, rule_pattern(plain))).otherwise(pieces_of(text, rule_pattern(rules)))


def rule_symbols(text: Column, rules: list[Rule] = PERSONAL_DATA) -> Column:
    """Symbols found by a rule table; the first rule that fits a piece gives kind and scope."""

    def first(field: str, piece: Column) -> Column:
        choice = F.lit(None).cast("string")
        for rule in reversed(rules):
            choice = F.when(piece.rlike(f"^(?:{rule.pattern})$"), F.lit(getattr(rule, field))).otherwise(choice)
        return choice

    return F.transform(
        groups(rule_pieces(text, rules)),
        lambda s: F.struct(
            s["key"].alias("name"),
            first("kind", s["key"]).alias("kind"),
            first("scope", s["key"]).alias("scope"),
            s["at"].alias("at"),
        ),
    ).cast(BINDING)


# --- declared symbols in code -------------------------------------------------------------


def code_lines(text: Column, language: str) -> Column:
    """Logical lines without strings and comments; a signature over several lines becomes one."""
    bare = F.regexp_replace(text, f"{STRINGS[language]}|{COMMENTS[language]}", '""')
    brackets = r"\((?:[^()]++|\([^()]*+\))*+\)"
    joined = let(
        bare,
        lambda b: weave(
            gaps_of(b, brackets),
            F.transform(pieces_of(b, brackets), lambda p: F.replace(p, F.lit("\n"), F.lit(" "))),
        ),
    )
    return F.filter(F.split(joined, "\n", -1), lambda line: line.rlike(r"\S"))


def _parameters(signature: Column, pattern: str) -> Column:
    flat = F.regexp_replace(F.regexp_replace(signature, r"\[[^\[\]]*\]", ""), r"\[[^\[\]]*\]", "")
    return F.filter(
        F.transform(F.split(flat, ",", -1), lambda p: F.regexp_extract(p, pattern, 1)),
        lambda n: n != "",
    )


def _symbol(name: Column, kind: Column | str, scope: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(name.alias("name"), kind.alias("kind"), scope.alias("scope"))


def _python_line(line: Column, scope: Column) -> Column:
    """Symbols declared by one logical line of Python inside ``scope``."""
    empty = F.array().cast(SYMBOLS)
    header = rf"^\s*(?:async\s+)?def\s+({NAME})\s*\(([^)]*)\)?"
    name = F.regexp_extract(line, header, 1)
    inner = F.when(scope == "", name).otherwise(F.concat(scope, F.lit("::"), name))
    functions = F.concat(
        F.array(_symbol(name, F.when(scope == "", "function").otherwise("method"), scope)).cast(SYMBOLS),
        F.transform(
            _parameters(F.regexp_extract(line, header, 2), rf"^\s*\*{{0,2}}\s*({NAME})"),
            lambda p: _symbol(p, "parameter", inner),
        ).cast(SYMBOLS),
    )
    classes = F.array(_symbol(F.regexp_extract(line, rf"^\s*class\s+({NAME})", 1), "class", scope)).cast(SYMBOLS)
    annotated = F.array(_symbol(F.regexp_extract(line, rf"^\s*({NAME})\s*:", 1), "field", scope)).cast(SYMBOLS)
    own = F.array(
        _symbol(F.regexp_extract(line, rf"^\s*(?:self|cls)\.({NAME})\s*(?::[^=]*)?=", 1), "field", scope)
    ).cast(SYMBOLS)
    looped = F.regexp_extract(line, r"^\s*(?:async\s+)?for\s+(.+?)\s+in\s", 1)
    # Each blank has one place and nothing is given back, so a line costs its length, however many names it has.
    target = rf"[(\[\s*]*+{NAME}(?:\.{NAME})*+[)\]\s]*+"
    assigned = F.regexp_extract(line, rf"^\s*+((?:{target}(?:,{target})*+(?:,\s*+)?+=(?!=)\s*+)++)", 1)
    augmented = F.regexp_extract(line, rf"^\s*({NAME})\s*(?:[-+*/%&|^@]|//|\*\*|<<|>>)=", 1)

    def variables(targets: Column) -> Column:
        alone = rf"(?<![.\p{{L}}\p{{N}}_]){NAME}(?![.\p{{L}}\p{{N}}_])"
        return F.transform(pieces_of(targets, alone), lambda n: _symbol(n, "variable", scope)).cast(SYMBOLS)

    return (
        F.when(line.rlike(r"^\s*(?:async\s+)?def\s"), functions)
        .when(line.rlike(r"^\s*class\s"), classes)
        .when(line.rlike(rf"^\s*(?:self|cls)\.{NAME}\s*(?::[^=]*)?=(?!=)"), own)
        .when(line.rlike(rf"^\s*{NAME}\s*:(?!=)"), annotated)
        .when(looped != "", variables(looped))
        .when(augmented != "", variables(augmented))
        .when(assigned != "", variables(assigned))
        .otherwise(empty)
    )


def _python_declared(text: Column) -> Column:
    """Walk over the lines with the stack of open classes and functions as the state."""
    state = "struct<open:array<struct<depth:int,name:string>>,found:array<struct<name:string,kind:string,scope:string>>>"

    def step(acc: Column, line: Column) -> Column:
        wide = F.replace(line, F.lit("\t"), F.lit("        "))
        depth = F.length(wide) - F.length(F.ltrim(wide))

        def with_open(still_open: Column) -> Column:
            scope = F.array_join(F.transform(still_open, lambda o: o["name"]), "::")
            header = F.regexp_extract(line, rf"^\s*(?:(?:async\s+)?def|class)\s+({NAME})", 1)
            return F.struct(
                F.when(
                    header != "",
                    F.concat(still_open, F.array(F.struct(depth.alias("depth"), header.alias("name")))),
                )
                .otherwise(still_open)
                .alias("open"),
                F.concat(acc["found"], let(scope, lambda s: _python_line(line, s))).alias("found"),
            ).cast(state)

        return let(F.filter(acc["open"], lambda o: o["depth"] < depth), with_open)

    start = F.struct(
        F.array().cast("array<struct<depth:int,name:string>>").alias("open"),
        F.array().cast(SYMBOLS).alias("found"),
    ).cast(state)
    return F.aggregate(code_lines(text, "python"), start, step)["found"]


def declared_symbols(text: Column, language: str) -> Column:
    """array<struct<name, kind, scope>>; the first declaration of a name in a document wins."""
    if language == "python":
        symbols = let(
            F.coalesce(imported_names(text), F.array().cast("array<string>")),
            lambda names: F.filter(
                _python_declared(text), lambda s: is_user_name(s["name"], "python", names)
            ),
        )
    else:
        symbols = F.filter(cpp_declared(text), lambda s: is_user_name(s["name"], "cpp"))
    return firsts(symbols, "name").cast(SYMBOLS)


def code_symbols(text: Column, language: str) -> Column:
    """Declared symbols with the places where they stand outside strings, comments and imports."""
    row = "array<struct<name:string,at:int,kind:string,scope:string>>"
    declared = F.transform(
        declared_symbols(text, language),
        lambda s: F.struct(s["name"].alias("name"), F.lit(-1).alias("at"), s["kind"].alias("kind"), s["scope"].alias("scope")),
    ).cast(row)
    places = F.filter(
        F.transform(
            pieces_of(text, SCAN[language]),
            lambda p, i: F.struct(
                p.alias("name"),
                i.alias("at"),
                F.lit(None).cast("string").alias("kind"),
                F.lit(None).cast("string").alias("scope"),
            ),
        ),
        lambda s: s["name"].rlike(IS_NAME),
    ).cast(row)
    named = F.filter(
        runs(F.sort_array(F.concat(declared, places)), "name"),
        lambda run: F.get(run, F.lit(0))["at"] == -1,
    )
    return F.transform(
        named,
        lambda run: F.struct(
            F.get(run, F.lit(0))["name"].alias("name"),
            F.get(run, F.lit(0))["kind"].alias("kind"),
            F.get(run, F.lit(0))["scope"].alias("scope"),
            F.transform(F.slice(run, F.lit(2), F.size(run)), lambda s: s["at"]).alias("at"),
        ),
    ).cast(BINDING)


def binding_of(text: Column, scan: str) -> Column:
    """The symbols of a text with their places, for one way to scan it."""
    return prose_symbols(text, scan) if scan in ("prose", "quoted") else code_symbols(text, scan)


def symbols(docs: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per symbol of a document, ready for the dictionary: (id, name, kind, scope, at)."""
    return docs.select(id_col, F.explode(binding_of(F.col(text_col), language)).alias("s")).select(id_col, "s.*")


def symbols_by_rule(
    docs: DataFrame, rules: list[Rule] = PERSONAL_DATA, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    return docs.select(id_col, F.explode(rule_symbols(F.col(text_col), rules)).alias("s")).select(id_col, "s.*")


def first_symbols(rows: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One (id, name, kind, scope) per name of a document: the first one declared wins."""
    return (
        rows.groupBy(id_col, "name")
        .agg(F.min_by(F.struct("kind", "scope"), order_col).alias("s"))
        .select(id_col, "name", "s.kind", "s.scope")
    )


def comment_spans(docs: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per comment: offsets, line and text. Strings are passed over first."""
    pattern = f"{STRINGS[language]}|{COMMENTS[language]}"
    found = F.filter(
        located(F.col(text_col), pattern), lambda o: o["piece"].rlike(f"^(?:{COMMENTS[language]})")
    )
    spans = docs.select(id_col, F.explode(found).alias("o")).select(
        id_col,
        F.col("o.offset").cast("bigint").alias("offset"),
        F.col("o.end_offset").cast("bigint").alias("end_offset"),
        F.col("o.line").cast("bigint").alias("line"),
        F.col("o.piece").alias("comment"),
    )
    if language != "python":
        return spans
    lead = rf"{DOCSTRING_LEAD}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')"
    docstrings = docs.select(id_col, F.explode(located(F.col(text_col), lead)).alias("o")).select(
        id_col,
        (F.col("o.end_offset") - F.length(F.regexp_extract("o.piece", r"(\"\"\"[\s\S]*|'''[\s\S]*)$", 1)))
        .cast("bigint")
        .alias("offset"),
        F.col("o.end_offset").cast("bigint").alias("end_offset"),
        (
            F.col("o.line")
            + F.length(F.regexp_extract("o.piece", r"^(:?\s*)", 1))
            - F.length(F.replace(F.regexp_extract("o.piece", r"^(:?\s*)", 1), F.lit("\n"), F.lit("")))
        )
        .cast("bigint")
        .alias("line"),
        F.regexp_extract("o.piece", r"(\"\"\"[\s\S]*|'''[\s\S]*)$", 1).alias("comment"),
    )
    return spans.unionByName(docstrings)


# Words before a parenthesis that are no calls.
NOT_CALLS = [
    "if", "for", "while", "switch", "catch", "return", "sizeof", "typeof",
    "decltype", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast",
]


def called_names(body: Column) -> Column:
    """Distinct names that stand before an opening parenthesis."""
    return F.array_sort(
        F.array_distinct(
            F.filter(
                F.regexp_extract_all(body, F.lit(r"(?<![\p{L}\p{N}_])([A-Za-z_][\p{L}\p{N}_]*)\s*\("), F.lit(1)),
                lambda n: ~n.isin(NOT_CALLS),
            )
        )
    )
