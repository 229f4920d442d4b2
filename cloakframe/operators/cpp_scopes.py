"""Declared names of C++ with kind and scope, from one pass over the statements of a text.

A text without strings and comments is cut into *statements*: what stands before each ``{``, ``}`` and ``;`` (those in the
head of a ``for`` don't count). The depth of braces is a running sum. The block that a statement stands in is the
last brace opened one level above it, found for all statements by one sort on (depth, place). What a block is (namespace,
class, enum, function, other code) follows from its head; its full name is put together from the blocks around it by
pointer jumping, so nesting of depth d takes log d rounds. Then every statement is read once, knowing the kind of
block it stands in: the same ``int x;`` is a field in a class and a variable in a function.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind, let, pieces_of, sql_let, sql_sums
from cloakframe.functions.patterns import COMMENTS, NAME, STRINGS, WORD_CHAR

SYMBOLS = "array<struct<name:string,kind:string,scope:string>>"

_END = rf"(?!{WORD_CHAR})"
_START = rf"(?<!{WORD_CHAR})"
_PAREN = r"\((?:[^(){}]++|\([^(){}]*+\))*+\)"
_STATEMENT = rf"\G(?:[^{{}};f]++|{_START}for\s*+\((?:[^(){{}}]++|{_PAREN})*+\)|f)*+[{{}};]"
_DIRECTIVE = r"(?m)^[ \t]*+#(?:[^\n\\]++|\\[\s\S])*+"
_MACRO = rf"(?m)^[ \t]*+#[ \t]*+define[ \t]++({NAME})"
_ANGLES = r"<(?:[^<>{};]++|<(?:[^<>{};]++|<[^<>{};]*+>)*+>)*+>"
# What may stand in front of a declaration and says nothing about it.
_LEAD = (
    rf"^(?:\s*+(?:(?:public|private|protected)\s*+:(?!:)|(?:case{_END}[^:?]*+|default)\s*+:(?!:)"
    rf"|template\s*+{_ANGLES}|\[\[[^\]]*+\]\]|extern\s*+\"\"))*+\s*+"
)

_NAMESPACE = rf"^(?:inline\s+)?namespace{_END}\s*({NAME}(?:::{NAME})*)?\s*$"
_ENUM = rf"^(?:typedef\s+)?enum{_END}(?:\s+(?:class|struct){_END})?\s*({NAME})?\s*(?::(?!:)[\s\S]*)?$"
_RECORD = rf"^(?:typedef\s+)?(class|struct|union){_END}(?:\s*alignas\s*\([^)]*\))?\s*({NAME})?(?:\s+final)?\s*(?::(?!:)[\s\S]*)?$"
_DECLARED = rf"^(enum|class|struct|union)\s+(?:(?:class|struct)\s+)?({NAME})\s*(?::\s*{NAME}(?:::{NAME})*\s*)?$"
_CONTROL = rf"^(?:else\s+)?(?:if|for|while|switch|catch|do|else|try|return){_END}"
# What stands before the first parenthesis of a function. It holds no "=", so that calls in an initial value are none.
_FUNCTION = rf"^[^=]*?{_START}((?:{NAME}\s*::\s*)*)~?({NAME})\s*\z"
_ARGUMENTS = r"^((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)"
_PARAMETER = rf"^[^=]*[\s*&]({NAME})\s*(?:\[[^\]]*\]\s*)*(?:=|$)"
_TYPEDEF = rf"^typedef\s[\s\S]*?(?:\(\s*\*\s*({NAME})\s*\)[\s\S]*|{_START}({NAME})\s*(?:\[[^\]]*\]\s*)*)$"
_USING = rf"^using\s+({NAME})\s*="
_OTHER = (
    rf"^(?:return|delete|throw|goto|using|friend|break|continue|else|if|while|switch|do|for|catch|try|new|typedef|namespace"
    rf"|static_assert|co_return|co_yield|co_await|operator){_END}"
)
_TYPE = (
    r"(?:(?:const|static|constexpr|inline|mutable|volatile|unsigned|signed|long|short|extern|register|thread_local|typename|struct|class|enum|union)\s+)*"
    rf"(?:::)?{NAME}(?:::{NAME})*(?:\s*{_ANGLES})?(?:::{NAME})*(?:\s*[*&]+\s*(?:const\s+)?|\s+)"
)
_VARIABLE = rf"^{_TYPE}({NAME})\s*(?:$|[=:](?!:))"
_NEXT = rf"^[\s*&]*({NAME})\s*(?:$|=|:(?!:))"
_HEAD_VARIABLE = rf"^(?:else\s+)?(?:for|if|while|switch|catch)\s*\(\s*{_TYPE}({NAME})\s*(?:=(?!=)|:(?!:)|[,){{])"
_CONSTANT = rf"^\s*({NAME})"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _symbol(name: Column, kind: Column | str, scope: Column) -> Column:
    return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), scope.alias("scope"))


def _tight(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+", "")


def _before(head: Column) -> Column:
    """What stands before the first parenthesis: patterns read this much and not the arguments, however many there are."""
    return F.substring_index(head, "(", 1)


def _is_function(head: Column) -> Column:
    return head.contains("(") & _before(head).rlike(_FUNCTION)


def _function_name(head: Column) -> Column:
    return _group(_before(head), _FUNCTION, 2)


def _behind(head: Column) -> Column:
    """What stands behind the first parenthesis."""
    return F.substring(head, F.length(_before(head)) + 2, F.length(head))


def _qualifier(head: Column) -> Column:
    """``Box`` of ``void Box::run(``, or nothing."""
    return F.regexp_replace(_tight(_group(_before(head), _FUNCTION)), "::$", "")


def _without(text: Column, pattern: str, signs: str, by: str = "") -> Column:
    """``text`` with ``by`` for what fits ``pattern``; it is read only when it holds one of ``signs``, as every match does."""
    return F.when(reduce(or_, [text.contains(s) for s in signs]), F.regexp_replace(text, pattern, by)).otherwise(text)


def _block(head: Column) -> Column:
    """struct<kind, part>: what a head opens, and what it adds to the names of the blocks in it, with ``::`` before."""

    def named(kind: Column | str, name: Column) -> Column:
        part = F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.concat(F.lit("::"), name))
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), part.alias("part"))

    function = F.concat_ws("::", F.nullif(_qualifier(head), F.lit("")), _function_name(head))
    return (
        F.when(head.rlike(_NAMESPACE), named("namespace", _group(head, _NAMESPACE)))
        .when(head.rlike(_ENUM), named("enum", _group(head, _ENUM)))
        .when(head.rlike(_RECORD), named("record", _group(head, _RECORD, 2)))
        .when(~head.rlike(_CONTROL) & _is_function(head), named("function", function))
        .otherwise(named("code", F.lit("")))
    )


# For each statement of s.q (sign, head, block): the kind and full name of the block around it, and the head of
# the block that closes right before it.
_AROUND = {
    "before": sql_sums("dc"),
    "marks": (
        "sort_array(concat("
        "transform(s.q, (x, i) -> struct(bf[i] AS l, i AS i, 0 AS o)), "
        "filter(transform(s.q, (x, i) -> IF(x.sign = '{', struct(bf[i] + 1 AS l, i AS i, 1 AS o), NULL)), x -> x IS NOT NULL)))"
    ),
    "starts": "filter(transform(mk, (e, k) -> k), k -> k = 0 OR mk[k].o = 1 OR mk[k].l <> mk[k - 1].l)",
    "runs": "transform(st, (f, k) -> slice(mk, f + 1, coalesce(get(st, k + 1), size(mk)) - f))",
    "owners": (
        "transform(sort_array(flatten(transform(rn, r -> transform(filter(r, e -> e.o = 0), "
        "e -> struct(e.i AS i, IF(r[0].o = 1, r[0].i, -1) AS b))))), x -> x.b)"
    ),
    "paths": (
        "aggregate(sequence(1, length(bin(greatest(coalesce(array_max(bf), 0), 1)))), "
        "transform(s.q, (x, i) -> struct(ow[i] AS j, coalesce(x.block.part, '') AS p)), "
        "(a, r) -> transform(a, x -> IF(x.j < 0, x, struct(get(a, x.j).j AS j, concat(get(a, x.j).p, x.p) AS p))))"
    ),
}
_ROWS = (
    "transform(s.q, (x, i) -> named_struct('sign', x.sign, 'head', x.head, 'block', x.block.kind, "
    "'inside', IF(ow[i] < 0, 'top', s.q[ow[i]].block.kind), 'scope', IF(ow[i] < 0, '', substring(pt[ow[i]].p, 3)), "
    "'closed', IF(i > 0 AND get(s.q, i - 1).sign = '}', get(s.q, get(ow, i - 1)).head, NULL)))"
)
_PLACED = sql_let(
    "transform(s.q, x -> CASE x.sign WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END)",
    "dc",
    sql_let(
        _AROUND["before"],
        "bf",
        sql_let(
            _AROUND["marks"],
            "mk",
            sql_let(
                _AROUND["starts"],
                "st",
                sql_let(_AROUND["runs"], "rn", sql_let(_AROUND["owners"], "ow", sql_let(_AROUND["paths"], "pt", _ROWS))),
            ),
        ),
    ),
)


def _bare(head: Column) -> Column:
    """Without its lead, which is matched once, at the start, and not looked for at every character."""
    return F.substring(head, F.length(_group(head, _LEAD, 0)) + 1, F.length(head))


def _stripped(head: Column) -> Column:
    """Without blanks at the end; those are looked for only when the last character can be one, or a line's end behind one."""
    return F.when(F.right(head, F.lit(1)).rlike("[\\s\u0085\u2028\u2029]"), F.regexp_replace(head, r"\s+$", "")).otherwise(head)


def statements(text: Column) -> Column:
    """array<struct<sign, head, block, inside, scope, closed>> of C++ without strings, comments and directives."""

    def cut(piece: Column) -> Column:
        return let(
            let(let(F.substring(piece, F.lit(1), F.length(piece) - 1), _bare), _stripped),
            lambda h: F.struct(
                F.right(piece, F.lit(1)).alias("sign"),
                h.alias("head"),
                F.when(F.right(piece, F.lit(1)) == "{", _block(h)).alias("block"),
            ),
        )

    return bind(_PLACED, q=F.transform(pieces_of(text, _STATEMENT), cut))


def _parameters(rest: Column, scope: Column) -> Column:
    """Parameters in what stands behind the opening parenthesis; ``scope`` is bound."""
    listed = let(_group(rest, _ARGUMENTS), lambda a: _without(a, f"{_ANGLES}|{_PAREN}", "<(", " "))
    names = F.transform(F.split(listed, ",", -1), lambda p: _group(p, _PARAMETER))
    return F.transform(F.filter(names, lambda n: n != ""), lambda n: _symbol(n, "parameter", scope)).cast(SYMBOLS)


def _functions(x: Column) -> Column:
    """A function or method and its parameters."""
    parts = F.struct(
        _qualifier(x["head"]).alias("owner"), _function_name(x["head"]).alias("name"), _behind(x["head"]).alias("rest")
    )

    def read(f: Column) -> Column:
        scope = F.concat_ws("::", F.nullif(x["scope"], F.lit("")), F.nullif(f["owner"], F.lit("")))
        kind = F.when((x["inside"] == "record") | (f["owner"] != ""), "method").otherwise("function")
        own = F.filter(F.array(_symbol(f["name"], kind, scope)), lambda s: ~s["name"].startswith("operator"))
        inner = F.concat_ws("::", F.nullif(scope, F.lit("")), f["name"])
        return F.concat(own.cast(SYMBOLS), let(inner, lambda i: _parameters(f["rest"], i)))

    return let(parts, read)


def _variables(x: Column) -> Column:
    """All names of a declaration; what stands in brackets is left out before it is cut at commas."""
    kind = F.when(x["inside"] == "record", "field").otherwise("variable")
    bare = _without(x["head"], rf"{_PAREN}|\[[^\[\]]*+\]", "([")

    def read(parts: Column) -> Column:
        first = _group(F.get(parts, F.lit(0)), _VARIABLE)
        others = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: _group(p, _NEXT))
        names = F.when(first == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(first), others))
        return F.transform(F.filter(names, lambda n: n != ""), lambda n: _symbol(n, kind, x["scope"])).cast(SYMBOLS)

    # Commas between template arguments don't part names: they go with their brackets where they follow a name.
    named = let(bare, lambda b: _without(b, rf"(?<={WORD_CHAR})\s*{_ANGLES}(?=[\s*&:])", "<"))
    return let(F.split(named, ",", -1), read)


def _one(name: Column, kind: Column | str, scope: Column) -> Column:
    return F.filter(F.array(_symbol(name, kind, scope)), lambda s: s["name"] != "").cast(SYMBOLS)


def _declared(x: Column) -> Column:
    """The symbols that one statement declares."""
    head, scope = x["head"], x["scope"]
    outside = x["inside"].isin("top", "namespace", "record")
    record = F.when(_group(head, _RECORD) == "class", "class").otherwise("struct")
    declared = F.when(_group(head, _DECLARED) == "enum", "enum").when(_group(head, _DECLARED) == "class", "class").otherwise("struct")
    is_function = _is_function(head) & ~head.rlike(_CONTROL) & ~head.rlike(_OTHER) & _behind(head).rlike(_ARGUMENTS)
    constants = F.transform(
        F.filter(
            F.transform(F.split(_without(head, _PAREN, "("), ",", -1), lambda p: _group(p, _CONSTANT)), lambda n: n != ""
        ),
        lambda n: _symbol(n, "enum_constant", scope),
    ).cast(SYMBOLS)
    typedef = F.coalesce(F.nullif(_group(head, _TYPEDEF), F.lit("")), _group(head, _TYPEDEF, 2))
    kind = F.when(x["inside"] == "record", "field").otherwise("variable")
    named_after = F.when(F.coalesce(x["closed"].startswith("typedef"), F.lit(False)), "typedef").otherwise(kind)
    namespaces = F.transform(
        F.filter(F.split(_group(head, _NAMESPACE), "::", -1), lambda n: n != ""), lambda n: _symbol(n, "namespace", scope)
    ).cast(SYMBOLS)
    opens = x["sign"] == "{"
    return (
        F.when(x["inside"] == "enum", constants)
        .when(opens & (x["block"] == "namespace"), namespaces)
        .when(opens & (x["block"] == "enum"), _one(_group(head, _ENUM), "enum", scope))
        .when(opens & (x["block"] == "record"), _one(_group(head, _RECORD, 2), record, scope))
        .when(head.rlike(_HEAD_VARIABLE), _one(_group(head, _HEAD_VARIABLE), "variable", scope))
        .when(head.rlike(_USING), _one(_group(head, _USING), "type_alias", scope))
        .when(head.rlike(r"^typedef\s"), _one(typedef, "typedef", scope))
        .when((x["sign"] == ";") & head.rlike(_DECLARED), _one(_group(head, _DECLARED, 2), declared, scope))
        .when(
            x["closed"].rlike(f"{_RECORD}|{_ENUM}") & head.rlike(rf"^[\s*&]*{NAME}$"),
            _one(_group(head, rf"({NAME})$"), named_after, scope),
        )
        .when(outside & is_function, _functions(x))
        .when(head.rlike(_OTHER), F.array().cast(SYMBOLS))
        .otherwise(_variables(x))
    )


def cpp_declared(text: Column) -> Column:
    """array<struct<name, kind, scope>> in the order of the text, macros first."""
    bare = F.regexp_replace(text, f"(?=[\"'/])(?:{STRINGS['cpp']}|{COMMENTS['cpp']})", '""')

    def read(source: Column) -> Column:
        macros = F.transform(F.regexp_extract_all(source, F.lit(_MACRO), F.lit(1)), lambda n: _symbol(n, "macro", F.lit("")))
        rows = statements(F.regexp_replace(source, _DIRECTIVE, ""))
        return F.concat(macros.cast(SYMBOLS), F.flatten(F.transform(rows, _declared)))

    return let(bare, read)
