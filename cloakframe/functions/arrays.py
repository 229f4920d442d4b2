"""Column helpers for work inside one row, all built from Spark's higher-order functions.

A text is taken apart by a pattern into ``gap piece gap piece … gap``. The helpers below locate
pieces, group equal pieces and put a text together again. Each is linear (or n log n) in the
text, needs no shuffle, and never looks at a column from inside a lambda without binding it
first: Catalyst may inline a column into the lambda and would then evaluate it per element.

Bodies are SQL lambdas that see only what is bound to them: they are parsed in one call, where
the same tree built call by call from Python would take seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 4
_BLOCK = 1 << _BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(body: str, **values: Column) -> Column:
    """Evaluate the values once and the SQL ``body`` over them, as fields of ``s``."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.call_function("transform", bound, F.expr(f"s -> {body}")), F.lit(0))


def sql_let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def pieces_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps_of(text: Column, pattern: str) -> Column:
    """The text around the pieces: always one element more than there are pieces."""
    return F.split(text, pattern, -1)


def weave(gaps: Column, pieces: Column) -> Column:
    zipped = F.call_function("zip_with", gaps, pieces, F.expr("(g, p) -> concat(g, coalesce(p, ''))"))
    return F.array_join(zipped, "")


def _total(values: str) -> str:
    return f"aggregate({values}, 0, (a, x) -> a + x)"


def sql_sums(v: str, depth: int = 2) -> str:
    """For each element of the bound array ``v`` the sum of those before it.

    Sums are taken per block of 16, then over the blocks, so that a text with a million pieces
    costs some ten million additions and not half a trillion.
    """
    if depth == 0:
        return f"transform({v}, (e, i) -> {_total(f'slice({v}, 1, i)')})"
    totals = (
        f"transform(sequence(0, shiftright(greatest(size({v}) - 1, 0), {_BITS})), "
        f"b -> {_total(f'slice({v}, shiftleft(b, {_BITS}) + 1, {_BLOCK})')})"
    )
    block = f"shiftright(i, {_BITS})"
    inside = _total(f"slice({v}, shiftleft({block}, {_BITS}) + 1, i & {_BLOCK - 1})")
    t, p = f"t{depth}", f"p{depth}"
    return sql_let(
        totals, t, sql_let(sql_sums(t, depth - 1), p, f"transform({v}, (e, i) -> {p}[{block}] + {inside})")
    )


def exclusive_sums(values: Column) -> Column:
    return bind(sql_sums("s.v"), v=values)


# Levels of minima over blocks of 32: a search looks at 32 places per level and at n / 32,768 at the top.
_WIDE = 5
_LEVELS = 3


def _sql_hit(values: str, start: str, count: str, bound: str) -> str:
    """The first place from ``start`` on, among ``count``, with a value below ``bound``; or null."""
    places = f"transform(slice({values}, {start} + 1, {count}), (x, k) -> IF(x < {bound}, {start} + k, NULL))"
    return f"get(filter({places}, x -> x IS NOT NULL), 0)"


def sql_minima(name: str, body: str, **arrays: str) -> str:
    """Bind arrays, with their minima per block, per block of blocks …, to the fields of ``name``."""
    made = body
    for level in range(_LEVELS, -1, -1):
        fields = []
        for field, values in arrays.items():
            fields += [f"'{field}{k}', {name}{level - 1}.{field}{k}" for k in range(level)]
            if level:
                below = f"{name}{level - 1}.{field}{level - 1}"
                blocks = f"sequence(0, shiftright(greatest(size({below}) - 1, 0), {_WIDE}))"
                values = f"transform({blocks}, b -> array_min(slice({below}, shiftleft(b, {_WIDE}) + 1, {1 << _WIDE})))"
            fields.append(f"'{field}{level}', {values}")
        made = sql_let(f"named_struct({', '.join(fields)})", name if level == _LEVELS else f"{name}{level}", made)
    return made


def sql_first_below(minima: str, start: str, bound: str) -> str:
    """The first place from the bound ``start`` on whose value is below ``bound``, or null.

    ``minima`` is an array of ``sql_minima`` (``name.field``). The rest of the block is searched, then the blocks
    behind it on each level, and from a hit down to its place: no value is passed one by one, so many searches in a
    long array stay linear.
    """

    def down(level: int, place: str) -> str:
        if not level:
            return place
        hit = _sql_hit(f"{minima}{level - 1}", f"shiftleft({place}, {_WIDE})", str(1 << _WIDE), bound)
        return hit if level == 1 else sql_let(hit, f"d{level}", down(level - 1, f"d{level}"))

    cases, place = [], start
    for level in range(_LEVELS + 1):
        values = f"{minima}{level}"
        count = f"size({values})" if level == _LEVELS else f"{1 << _WIDE} - ({place} & {(1 << _WIDE) - 1})"
        hit = _sql_hit(values, place, count, bound)
        cases.append(hit if not level else sql_let(hit, "hit", down(level, "hit")))
        place = f"(shiftright({place}, {_WIDE}) + 1)"
    return f"coalesce({', '.join(cases)})"


def _newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, char(10), '')))"


# Width of every piece with the gap before it; no lookup by index is needed.
_WIDTHS = "zip_with(s.p, slice(s.g, 1, size(s.p)), (p, g) -> length(p) + length(g))"
_BREAKS = f"zip_with(s.p, slice(s.g, 1, size(s.p)), (p, g) -> {_newlines('p')} + {_newlines('g')})"


def with_offsets(text: Column, pattern: str) -> Column:
    """array<struct<piece, at, offset, end_offset>>; offsets from 0."""
    offsets = f"transform({sql_sums('w')}, (b, i) -> b + length(s.g[i]))"
    rows = (
        "transform(s.p, (piece, i) -> named_struct('piece', piece, 'at', i, "
        "'offset', o[i], 'end_offset', o[i] + length(piece)))"
    )
    return bind(
        sql_let(_WIDTHS, "w", sql_let(offsets, "o", rows)), g=gaps_of(text, pattern), p=pieces_of(text, pattern)
    )


def sql_located(extra: str = "", with_col: bool = True) -> str:
    """Body for ``located``: needs s.g, s.p and, for the column, the widths of the lines s.l."""
    places = (
        "named_struct("
        f"'o', transform({sql_sums('u.w')}, (b, i) -> b + length(s.g[i])), "
        f"'n', transform({sql_sums('u.n')}, (b, i) -> b + {_newlines('s.g[i]')} + 1), "
        f"'l', {sql_sums('s.l') if with_col else '0'})"
    )
    col = "c.o[i] - c.l[c.n[i] - 1] + 1" if with_col else "0"
    rows = (
        "transform(s.p, (piece, i) -> named_struct('piece', piece, 'at', i, 'offset', c.o[i], "
        f"'end_offset', c.o[i] + length(piece), 'line', c.n[i], 'col', {col}{extra}))"
    )
    return sql_let(f"named_struct('w', {_WIDTHS}, 'n', {_BREAKS})", "u", sql_let(places, "c", rows))


def line_widths(text: Column) -> Column:
    return F.call_function("transform", F.split(text, "\n", -1), F.expr("x -> length(x) + 1"))


def located(text: Column, pattern: str) -> Column:
    """array<struct<piece, at, offset, end_offset, line, col>>; offsets from 0, line and col from 1."""
    return bind(sql_located(), g=gaps_of(text, pattern), p=pieces_of(text, pattern), l=line_widths(text))


def sql_runs(o: str, *fields: str) -> str:
    """Cut the bound sorted array ``o`` into array<array<…>> of neighbours equal in the fields."""

    def key(element: str) -> str:
        return f"struct({', '.join(f'{element}.{f}' for f in fields)})" if len(fields) > 1 else f"{element}.{fields[0]}"

    before = key(f"get({o}, i - 1)")
    here = key(f"get({o}, i)")
    starts = f"filter(transform({o}, (e, i) -> i), i -> i = 0 OR {before} <> {here})"
    return sql_let(
        starts,
        "st",
        f"transform(st, (f, k) -> slice({o}, f + 1, coalesce(get(st, k + 1), size({o})) - f))",
    )


def runs(ordered: Column, *fields: str) -> Column:
    return bind(sql_runs("s.o", *fields), o=ordered)


# Keys and places of sorted pieces as two arrays; a key's places are a slice of the second one.
_SLOTS = sql_let(
    "sort_array(transform(s.p, (p, i) -> named_struct('key', p, 'at', i)))",
    "o",
    sql_let(
        "named_struct('k', o.key, 'a', o.at)",
        "u",
        sql_let(
            "filter(transform(u.k, (e, i) -> IF(i = 0 OR get(u.k, i - 1) <> e, i, NULL)), i -> i IS NOT NULL)",
            "st",
            "transform(st, (f, k) -> named_struct('key', u.k[f], "
            "'at', slice(u.a, f + 1, coalesce(get(st, k + 1), size(u.k)) - f)))",
        ),
    ),
)
# The same by numbers: the place of a piece below the upper bits of its hash. Numbers are compared without a look into
# rows, which for structs takes most of the time of a scan, the more the more cores do it at once.
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1
_HASHED = sql_let(
    f"sort_array(transform(s.p, (p, i) -> (xxhash64(p) & {~_PLACE}L) | i))",
    "o",
    sql_let(
        f"filter(transform(o, (x, i) -> IF(i > 0 AND ((get(o, i - 1) ^ x) & {~_PLACE}L) = 0, NULL, i)), i -> i IS NOT NULL)",
        "st",
        # As many runs as there are different pieces: no two pieces share a hash.
        "IF(size(st) = size(array_distinct(s.p)), "
        + sql_let(
            f"transform(o, x -> CAST(x & {_PLACE}L AS INT))",
            "a",
            "transform(st, (f, k) -> named_struct('key', s.p[a[f]], "
            "'at', slice(a, f + 1, coalesce(get(st, k + 1), size(a)) - f)))",
        )
        + f", {_SLOTS})",
    ),
)


def groups(pieces: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<key, at array<int>>>: every distinct piece with the places where it stands, in no order of the pieces.

    ``keep`` is asked once per distinct piece. Pieces are grouped by their hashes; a text in which two pieces share one, or
    that has more pieces than places fit beside a hash, is grouped by the pieces themselves.
    """
    found = bind(f"IF(size(s.p) <= {_PLACE}, {_HASHED}, {_SLOTS})", p=pieces)
    return found if keep is None else F.filter(found, lambda x: keep(x["key"]))


def slots(pieces: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """``groups`` in the order of the pieces."""
    return F.sort_array(groups(pieces, keep))


# Of the values v of rows x the first ones, in the order of the rows, by numbers as above.
_FIRSTS_HASHED = sql_let(
    f"sort_array(transform(v, (e, i) -> (xxhash64(e) & {~_PLACE}L) | i))",
    "o",
    sql_let(
        f"filter(o, (e, i) -> i = 0 OR ((get(o, i - 1) ^ e) & {~_PLACE}L) <> 0)",
        "st",
        f"IF(size(st) = n, transform(sort_array(transform(st, e -> CAST(e & {_PLACE}L AS INT))), i -> s.x[i]), NULL)",
    ),
)
_FIRSTS = sql_let(
    "transform(s.x, e -> e.FIELD)",
    "v",
    sql_let(
        "size(array_distinct(v))",
        "n",
        f"IF(n = size(v), s.x, IF(size(v) <= {_PLACE}, {_FIRSTS_HASHED}, NULL))",
    ),
)


def firsts(rows: Column, field: str) -> Column:
    """For every value of a field of the rows the first row that has it, in no order of the values.

    Rows whose values all differ are left as they are. Where two values share a hash they are grouped themselves.
    """

    def by_value(bound: Column) -> Column:
        values = groups(F.transform(bound, lambda row: row[field]))
        slow = F.transform(values, lambda group: F.get(bound, F.get(group["at"], F.lit(0))))
        return F.coalesce(bind(_FIRSTS.replace("FIELD", field), x=bound), slow)

    return let(rows, by_value)


_PLACED = "array<struct<at:int,value:string>>"
_GIVEN = (
    "cast(flatten(transform(s.f, f -> transform(f.at, a -> named_struct('at', a, 'value', f.value)))) "
    f"AS {_PLACED})"
)
_KEPT = (
    "cast(transform(array_except(transform(s.p, (p, i) -> i), transform(q, x -> x.at)), "
    f"i -> named_struct('at', i, 'value', s.p[i])) AS {_PLACED})"
)
_ONE_EACH = "CASE WHEN size(m) = size(s.p) THEN m ELSE filter(m, (x, i) -> i = 0 OR get(m, i - 1).at <> x.at) END"
_FILL_ROWS = sql_let(
    _GIVEN,
    "q",
    sql_let(
        f"sort_array(concat(q, {_KEPT}))",
        "m",
        f"array_join(zip_with(s.g, {_ONE_EACH}, (g, x) -> concat(g, coalesce(x.value, ''))), '')",
    ),
)
# The same by numbers: a place above the number of what is put there. More of them than pieces: a place is named twice.
_NO_VALUE = (1 << 31) - 1
_FILL = sql_let(
    "flatten(transform(s.f, (f, k) -> transform(f.at, a -> shiftleft(CAST(a AS BIGINT), 32) | k)))",
    "q",
    sql_let(
        "sort_array(concat(q, transform(array_except(transform(s.p, (p, i) -> i), transform(q, x -> CAST(shiftright(x, 32) AS INT))), "
        f"i -> shiftleft(CAST(i AS BIGINT), 32) | {_NO_VALUE})))",
        "m",
        "IF(size(m) = size(s.p), array_join(zip_with(s.g, m, (g, x) -> concat(g, coalesce("
        f"CASE WHEN (x & {_NO_VALUE}) = {_NO_VALUE} THEN s.p[CAST(shiftright(x, 32) AS INT)] "
        f"WHEN x IS NOT NULL THEN s.f[CAST(x & {_NO_VALUE} AS INT)].value END, ''))), ''), {_FILL_ROWS})",
    ),
)


def fill(text: Column, pattern: str, filled: Column) -> Column:
    """Put ``filled`` (array<struct<value, at array<int>>>) in place of the pieces it names."""
    done = bind(_FILL, f=filled, g=gaps_of(text, pattern), p=pieces_of(text, pattern))
    return F.when(F.coalesce(F.size(filled), F.lit(0)) <= 0, text).otherwise(done)


#: Slots of a table that is asked inside a row (``lookups.in_row_table``).
IN_ROW_SLOTS = 1 << 16


def sql_in_row(table: str, key: str) -> str:
    """What the bound in-row table (struct of keys ``k`` and values ``v`` by slot) has for a key, or null."""
    slot = f"CAST(pmod(xxhash64({key}), {IN_ROW_SLOTS}) AS INT)"
    return f"get(get({table}.v, {slot}), CAST(array_position(get({table}.k, {slot}), {key}) AS INT) - 1)"


def fill_known(text: Column, pattern: str, filled: Column, table: Column, group: Column | None = None) -> Column:
    """``fill``; pieces that ``filled`` does not name give way to what the in-row ``table`` has for them.

    With ``group`` the keys of the table are ``in_row_key`` of that group and the piece.
    """
    key, of = ("w", {}) if group is None else (_KEY_IN_GROUP, {"m": group.cast("string")})
    known = bind(f"transform(s.p, w -> coalesce({sql_in_row('s.t', key)}, w))", p=pieces_of(text, pattern), t=table, **of)

    def put(pieces: Column) -> Column:
        none = F.coalesce(F.size(filled), F.lit(0)) <= 0
        gaps = gaps_of(text, pattern)
        return F.when(none, weave(gaps, pieces)).otherwise(bind(_FILL, f=filled, g=gaps, p=pieces))

    return let(known, put)


_KEY_IN_GROUP = "concat(s.m, ':', w)"


def in_row_key(group: Column, piece: Column) -> Column:
    """A key for pieces that mean other things in other groups; a piece holds no colon."""
    return F.concat(group.cast("string"), F.lit(":"), piece)


def unknown_slots(pieces: Column, wanted: str, table: Column, group: Column | None = None) -> Column:
    """struct<n, slots>: how many different pieces the in-row ``table`` has, and array<struct<key, at array<int>>> of those
    that fit the pattern ``wanted`` and are not in it."""
    key, of = ("w", {}) if group is None else (_KEY_IN_GROUP, {"m": group.cast("string")})
    hit = f"IF({sql_in_row('s.t', key)} IS NOT NULL, 1, IF(w RLIKE '{wanted}', -1, 0))"
    places = "filter(transform(h, (x, i) -> IF(x = -1, i, NULL)), i -> i IS NOT NULL)"
    body = (
        "named_struct('n', size(array_distinct(filter(s.p, (w, i) -> h[i] = 1))), "
        "'at', r, 'words', transform(r, i -> s.p[i]))"
    )
    split = bind(sql_let(f"transform(s.p, w -> {hit})", "h", sql_let(places, "r", body)), p=pieces, t=table, **of)

    def placed(x: Column) -> Column:
        return F.transform(
            groups(x["words"]),
            lambda g: F.struct(g["key"].alias("key"), F.transform(g["at"], lambda a: F.get(x["at"], a)).alias("at")),
        )

    return let(split, lambda x: F.struct(x["n"].alias("n"), placed(x).alias("slots")))
