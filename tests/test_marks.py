"""Texts that can't hold what a pattern looks for are told by a string they lack, with the same result."""

import re

from pyspark.sql import functions as F

from cloakframe.functions.arrays import pieces_of, slots
from cloakframe.functions.patterns import LITERAL, LITERAL_MARK, PERSONAL_DATA, STRUCTURE_MARKS, STRUCTURES
from cloakframe.operators import extract, literals, risk


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ODD = [
    "", "plain words", "exp (1) sort(a[1] [2]) < while (x) for k in z", "force texport resort xopen(", "SHA256 Md5 rsa xaes", "if x >= y",
    "loss epochs train", "selects SELECT xcommit commit", "requests.get( aiohttp. httpx(", "def a(x):\n  return a(1)\n", "[a]\n[b]",
    'say "hello there people" 0x1F 12.5 .5 a.5 x7 7x 3 150', "mail a.b@c.de or x@y, +49 123 456 789 or 1.2.3.4 and 1234567890123 4", "a" * 40,
    "+1 234 567 89", "no digits@here.org",
]


def test_structures_are_those_of_the_patterns_alone(texts):
    docs = texts(*ODD)
    alone = F.array_compact(
        F.array(*[
            F.when(F.col("text").rlike(p) & (risk.calls_itself(F.col("text")) if n == "recursive function" else F.lit(True)), F.lit(n))
            for n, p in STRUCTURES
        ])
    )
    for r in docs.select(risk.structures_in(F.col("text")).alias("found"), alone.alias("want")).collect():
        assert r.found == r.want
    for name, pattern in STRUCTURES:
        # Every structure but the one that ignores case has marks, and each mark stands in its pattern.
        marks = STRUCTURE_MARKS.get(name, [])
        assert marks or pattern.startswith("(?i)")
        assert all(m[0] == "[" or re.escape(m) in pattern or m in pattern for m in marks)


def test_a_text_is_asked_for_its_marks_before_it_is_read(texts):
    docs = texts(*ODD)
    assert plan(docs.select(risk.structures_in(F.col("text")))).count("Contains(") >= sum(map(len, STRUCTURE_MARKS.values()))
    assert "Contains(" in plan(docs.select(extract.rule_symbols(F.col("text"))))
    assert LITERAL_MARK in plan(docs.select(literals.literals_of(F.col("text"))))


def test_rule_pieces_are_those_of_all_rules(texts):
    for rules in (PERSONAL_DATA, PERSONAL_DATA[:1], PERSONAL_DATA[1:3]):
        rows = texts(*ODD, None).select(
            slots(extract.rule_pieces(F.col("text"), rules)).alias("found"), slots(pieces_of(F.col("text"), extract.rule_pattern(rules))).alias("want")
        )
        assert all(r.found == r.want for r in rows.collect())


def test_texts_without_literals(texts):
    rows = texts(*ODD, None).select("text", literals.literals_of(F.col("text")).alias("l"), F.size(pieces_of(F.col("text"), LITERAL)).alias("n"))
    for r in rows.collect():
        assert r.l is None if r.text is None else len(r.l) == r.n


def test_calls_that_print_are_told_without_regard_to_case(spark):
    df = spark.createDataFrame([("myLOGger(",), ("Reprinted (",), ("x(",), ("lo g(",)], "b string")
    found = df.select("b", literals.string_context(F.col("b")).alias("c"))
    assert {r.b: r.c for r in found.collect()} == {"myLOGger(": "printf", "Reprinted (": "printf", "x(": "other", "lo g(": "other"}
    assert "lower(" not in plan(found).lower().replace("tolower(", "")
