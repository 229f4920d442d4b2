"""Personal data: patterns propose spans, checksums confirm them, words before a span adjust its score.

Kinds: email, ip, card (Luhn), phone (number of digits), and two that the method adds: iban (mod-97) and
id (a number of 6 to 12 digits, only with a word such as "account" or "passport" before it).
Spans have a score between 0 and 1: a value of the kind, more when a fitting word stands among the 24
characters before the span, less when one that speaks against it does. The first four kinds are kept at any
score, the added ones from ``KEEP`` on.

Everything happens inside the row with built-in functions: no shuffle, no Python. Each pattern is linear in
long runs (possessive, and a run is entered at its start only); a text is only searched if a cheap test of its
characters allows a match. Offsets are code points, the end is exclusive.

Null texts are empty; empty texts have no spans. Rows repeat as given. Extra columns are ignored by
``pii_spans`` and kept by ``mask_pii``. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind, gaps_of, pieces_of, sql_let, sql_sums
from cloakframe.llm.common import fresh, whole_text

# The kinds in the order of results, their patterns as the specification has them.
KINDS = ["email", "ip", "card", "phone", "iban", "id"]
BASE = KINDS[:4]
_LOCAL = "[A-Za-z0-9._%+-]"
_NAME = "[A-Za-z0-9-]"
PATTERNS = {
    # \G: a match may start right behind the one before, inside a run of the same characters.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[0-9]++(?:[\x20-][0-9]++)*+|(?:[\x20-][0-9]++)++)",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "id": r"(?<![0-9A-Za-z.+-])[0-9]{6,12}(?![0-9A-Za-z])",
}
#: What a text must hold for its search to be worth it; each is implied by a match.
_POSSIBLE = {
    "email": "contains({t}, '@')",
    "ip": r"{t} rlike '[0-9]\\.[0-9]'",
    "card": r"{t} rlike '[0-9][\\x20-]?[0-9]'",
    "phone": r"{t} rlike '\\+[0-9]'",
    "iban": r"{t} rlike '[A-Z]{{2}}[0-9]{{2}}'",
    "id": r"({t} rlike '[0-9]{{6}}' AND {t} rlike '(?i)account|konto|passport|cuenta|compte|customer|ssn|steuer|licen[cs]e no')",
}
# Score of a kind, words that raise and lower it.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "id": 0.3}
FOR = {
    "email": "mail|contact|write to",
    "ip": "ip|host|address|server",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobil",
    "iban": "iban|konto|account|bank|cuenta|compte",
    "id": "account|konto|passport|cuenta|compte|customer|ssn|steuer|licen[cs]e no",
}
AGAINST = {
    "email": "example",
    "ip": "version|release|section",
    "card": "order|invoice|isbn|tracking",
    "phone": "isbn|version",
    "iban": "isbn|sku",
    "id": "version|page|year",
}
KEEP = 0.5
BEFORE = 24

_DIGITS = r"regexp_replace(x.piece, '[^0-9]', '')"
_LUHN = (
    "aggregate(transform(sequence(1, length(d)), i -> "
    "cast(substring(d, length(d) - i + 1, 1) AS int) * (2 - i % 2)), 0, (a, v) -> a + v - IF(v > 9, 9, 0)) % 10 = 0"
)
_PLAIN = r"replace(x.piece, ' ', '')"
_MOD97 = (
    "aggregate(transform(sequence(1, length(c)), i -> ascii(substring(c, i, 1))), 0, "
    "(a, v) -> IF(v < 58, a * 10 + v - 48, a * 100 + v - 55) % 97) = 1"
)
_VALID = {
    "email": "true",
    "ip": r"x.piece rlike '^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)(?:\\.|$)){4}$'",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {sql_let(_DIGITS, 'd', _LUHN)} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": (
        f"CASE WHEN length({_PLAIN}) BETWEEN 15 AND 34 THEN "
        f"{sql_let(f'concat(substring({_PLAIN}, 5), substring({_PLAIN}, 1, 4))', 'c', _MOD97)} ELSE false END"
    ),
    "id": "true",
}
_SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def _spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, end, kind, score>> of one kind, by place."""
    widths = "zip_with(s.p, slice(s.g, 1, size(s.p)), (p, g) -> length(p) + length(g))"
    rows = (
        "transform(s.p, (p, i) -> named_struct('piece', p, 'start', o[i] + length(s.g[i]), "
        f"'before', lower(right(s.g[i], {BEFORE}))))"
    )
    valid = f"filter({sql_let(widths, 'w', sql_let(sql_sums('w'), 'o', rows))}, x -> {_VALID[kind]})"
    score = (
        f"greatest(0D, least(1D, {SCORES[kind]}D + IF(x.before rlike '{FOR[kind]}', 0.3D, 0D) "
        f"- IF(x.before rlike '{AGAINST[kind]}', 0.4D, 0D)))"
    )
    scored = (
        f"transform({valid}, x -> named_struct('start', x.start, 'end', x.start + length(x.piece), "
        f"'kind', '{kind}', 'score', {score}))"
    )
    kept = scored if kind in BASE else f"filter({scored}, y -> y.score >= {KEEP}D)"
    return bind(f"cast({kept} AS {_SPANS})", g=gaps_of(text, PATTERNS[kind]), p=pieces_of(text, PATTERNS[kind]))


def spans(name: str = "text") -> list[Column]:
    """One array of spans per kind, of a column without nulls."""
    none = F.array().cast(_SPANS)
    return [
        F.when(F.expr(_POSSIBLE[kind].format(t=f"`{name}`")), _spans_of(F.col(name), kind)).otherwise(none).alias(kind)
        for kind in KINDS
    ]


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, one array of spans per kind)."""
    return docs.select("doc_id", whole_text().alias("_text")).select("doc_id", *spans("_text"))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the arrays of these kinds, by kind, then place, joined by commas."""
    one = [F.transform(k, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])) for k in kinds]
    return F.array_join(F.concat(*one), ",")


def _sql_reach(v: str, depth: int = 2) -> str:
    """For each element of the bound array of ints the largest of those before it (0 for the first), in blocks of 16."""
    if depth == 0:
        return f"transform({v}, (e, i) -> coalesce(array_max(slice({v}, 1, i)), 0))"
    tops = (
        f"transform(sequence(0, shiftright(greatest(size({v}) - 1, 0), 4)), "
        f"b -> coalesce(array_max(slice({v}, shiftleft(b, 4) + 1, 16)), 0))"
    )
    inside = f"coalesce(array_max(slice({v}, shiftleft(shiftright(i, 4), 4) + 1, i & 15)), 0)"
    t, p = f"m{depth}", f"q{depth}"
    return sql_let(
        tops, t, sql_let(_sql_reach(t, depth - 1), p, f"transform({v}, (e, i) -> greatest({p}[shiftright(i, 4)], {inside}))")
    )


_MASK = sql_let(
    "transform(s.f, x -> x.end)",
    "ends",
    sql_let(
        _sql_reach("ends"),
        "reach",
        sql_let(
            # Spans that overlap are one: it starts where a span starts behind all ends before it.
            "filter(sequence(0, size(s.f) - 1), i -> i = 0 OR s.f[i].start >= reach[i])",
            "first",
            sql_let(
                "transform(first, (a, k) -> named_struct('start', s.f[a].start, 'kind', s.f[a].kind, 'end', "
                "greatest(reach[coalesce(get(first, k + 1), size(s.f)) - 1], ends[coalesce(get(first, k + 1), size(s.f)) - 1])))",
                "islands",
                "concat(array_join(transform(islands, (x, k) -> concat(array_join(slice(s.c, "
                "coalesce(get(islands, k - 1).end, 0) + 1, x.start - coalesce(get(islands, k - 1).end, 0)), ''), "
                "'<', upper(x.kind), '>')), ''), "
                "array_join(slice(s.c, element_at(islands, -1).end + 1, size(s.c)), ''))",
            ),
        ),
    ),
)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by <KIND> (overlapping spans by the kind of the first)
    and n_chars, where there is such a column, brought up to date for changed texts."""
    text, places = fresh(docs, "_whole"), fresh(docs, "_spans")
    found = docs.select("*", whole_text().alias(text)).select(
        "*", F.array_sort(F.concat(*spans(text))).alias(places)
    )
    masked = bind(_MASK, f=F.col(places), c=F.split(F.col(text), ""))
    some = F.size(places) > 0
    new = found.withColumn(text, F.when(some, masked).otherwise(F.col("text")))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col(text).alias("text"))
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            columns.append(F.when(some, F.length(text).cast(kind)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return new.select(*columns)
