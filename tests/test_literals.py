import re

import pytest
import regex
from pyspark.sql import functions as F

from cloakframe.functions.patterns import DOMAIN_MARKS, MATH_CONSTANTS, PRINT_CALLS
from cloakframe.operators import dictionary as dic
from cloakframe.operators import literals as lit

CASES = [
    # text, literal, action, reason
    ('x = ""', '""', "keep", "trivial string"),
    ('#include "some/long/header_file.h"', '"some/long/header_file.h"', "keep", "include directive"),
    ('x = "a/b"', '"a/b"', "scrub", "domain indicator detected"),
    ('x = "USER_ID"', '"USER_ID"', "scrub", "domain indicator detected"),
    ('x = "my order x"', '"my order x"', "scrub", "contains symbol name 'order'"),
    ('print("ab")', '"ab"', "scrub", "log/print string (business context)"),
    ('printf(fmt, "ab")', '"ab"', "scrub", "log/print string (business context)"),
    ('catalog(1, "ab")', '"ab"', "scrub", "log/print string (business context)"),
    ('out << "ab"', '"ab"', "scrub", "log/print string (business context)"),
    ('x = "a string of more than 20"', '"a string of more than 20"', "scrub", "long descriptive string"),
    ('x = "medium"', '"medium"', "flag", "medium-length string (review recommended)"),
    ('x = "abcde"', '"abcde"', "keep", "short string"),
    ("x = 0xFF;", "0xFF", "keep", "unparseable literal"),
    ("x = 2;", "2", "keep", "generic integer"),
    ("x = 0x1F;", "0x1F", "keep", "generic integer"),
    ("x = 3.14159;", "3.14159", "keep", "known constant (pi)"),
    ("x = 0.5f;", "0.5f", "keep", "common float default"),
    ("x = 0xAB1;", "0xAB1", "scrub", "hex literal (potentially domain-specific)"),
    ("x = 101L;", "101L", "flag", "large integer (review recommended)"),
    ("x = 99999999999999999999999999999999999999999;", "9" * 41, "flag", "large integer (review recommended)"),
    ("for (i = 0; i < 64; i++)", "64", "flag", "loop bound dimension"),
    ("  y; for (i = 0; i < 64; i++)", "64", "flag", "loop bound dimension"),
    ("x = 100;", "100", "keep", "small integer"),
    ("x = 1e5;", "1e5", "flag", "non-trivial float (review recommended)"),
    ("x = 2.5;", "2.5", "flag", "non-trivial float (review recommended)"),
]


def test_every_branch(texts):
    rows = lit.literals(texts(*[c[0] for c in CASES]), F.array(F.lit("order"), F.lit("my"))).collect()
    got = {(r.doc_id, r.value): (r.action, r.reason) for r in rows}
    for i, (_, value, action, reason) in enumerate(CASES, 1):
        assert got[(i, value)] == (action, reason), CASES[i - 1]


def test_number_contexts(texts):
    rows = lit.literals(texts("if (x > 50) y", "x = y * 50", "x = 50", "for x in range(50)")).collect()
    assert {r.doc_id: r.context for r in rows} == {1: "comparison", 2: "arithmetic", 3: "assignment", 4: "loop_bound"}


_NUM = (
    r"0[xX][0-9a-fA-F]+[uUlL]*|[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?[fFlL]*|[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?[fFlL]*"
    r"|[0-9]+[eE][+-]?[0-9]+[fFlL]*|[0-9]+[uUlL]*"
)


def _brute(text, names):
    """Straight loop over one text, with slices of the text for all surroundings."""
    out = []
    for m in re.finditer(rf'"(?:[^"\\]|\\.)*"|\b(?:{_NUM})\b', text):
        start, piece = m.start(), m.group()
        if piece[0] != '"' and start and text[start - 1] == "_":
            continue
        begin = text.rfind("\n", 0, start) + 1
        end = text.find("\n", start)
        line = text[begin : len(text) if end < 0 else end]
        before = text[max(0, start - 80) : start]
        if piece[0] == '"':
            v = piece.strip('"')
            b = before.rstrip()
            call = regex.search(r"([\p{L}\p{N}_]+)\s*\([^)]*\Z", b)
            printing = bool(call) and (
                call[1] in PRINT_CALLS or "log" in call[1].lower() or "print" in call[1].lower()
            )
            ctx = "printf" if printing or "<<" in b[-30:] else "other"
            if len(v) <= 1:
                row = ("keep", "")
            elif line.strip().startswith("#include"):
                row = ("keep", "")
            elif re.search(DOMAIN_MARKS, v) or any(len(n) > 2 and n in v for n in names) or ctx == "printf" or len(v) > 20:
                row = ("scrub", ctx)
            else:
                row = ("flag" if len(v) > 5 else "keep", ctx)
        else:
            raw = piece.rstrip("fFlLuU")
            around = text[max(0, start - 10) : start] + text[start : start + 20]
            if line.strip().startswith("for") or "for (" in line[: start - begin]:
                ctx = "loop_bound"
            elif re.search("[<>]|==|!=", around):
                ctx = "comparison"
            else:
                ctx = "arithmetic" if re.search("[*/+%-]", around) else "assignment"
            try:
                n = int(raw, 16) if raw[:2] in ("0x", "0X") else float(raw) if re.search("[.eE]", raw) else int(raw)
            except ValueError:
                n = None
            if n is None or (isinstance(n, int) and n in (0, 1, 2)):
                row = ("keep", "")
            elif isinstance(n, float) and (
                any(abs(n - c) < 1e-6 for c, _ in MATH_CONSTANTS) or n in (0.0, 1.0, 0.5, 2.0)
            ):
                row = ("keep", "")
            elif isinstance(n, float):
                row = ("flag", ctx)
            elif raw[:2] in ("0x", "0X"):
                row = ("scrub", ctx)
            else:
                row = ("flag" if n > 100 or ctx == "loop_bound" else "keep", ctx)
        out.append((piece, start, text.count("\n", 0, start) + 1, *row))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force_on_random_texts(texts, seed):
    import random

    rng = random.Random(seed)
    parts = ['"', '"abc"', '"a/b c"', '"order no"', "12", "0x1A", "3.5f", ".5", "1.", "1e3", "gv_001", " ", "\n", "for (", ";",
             "print(", ")", "<<", "x", "=", "<", "*", "\\", "#include ", "_7", "x7", "101", "a long text of many words"]
    samples = ["".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 20, 60, 200, 400)]
    names = ["order", "ab"]
    rows = lit.literals(texts(*samples), F.array(*[F.lit(n) for n in names])).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.value, r.offset, r.line, r.action, r.context))
    for i, text in enumerate(samples, 1):
        assert sorted(got.get(i, []), key=lambda x: x[1]) == _brute(text, names)


def test_scrubbed_literals_become_tokens(texts):
    docs = texts('call("http://a.b", 0xAB1, "ok", "http://a.b")')
    found = lit.scrubbed_symbols(lit.literal_arrays(docs))
    entries = dic.build_dictionary(found)
    assert lit.mask_literals(docs, found, entries).head().text == 'call("gs_001", gc_001, "ok", "gs_001")'
    assert {(r.token, r.original) for r in entries.collect()} == {("gs_001", "http://a.b"), ("gc_001", "0xAB1")}


def test_summary(texts):
    row = lit.literal_summary(lit.literal_arrays(texts('x = 5\ny = "medium" + 7\nz = "http://x"'))).head()
    assert (row.n_scrub, row.n_keep, row.n_flag, row.kept_sample) == (1, 2, 1, "5, 7")
    assert row.flagged == '2: "medium" - medium-length string (review recommended)'


def test_names_inside_words_of_strings(spark):
    import random

    draw = random.Random(8)
    parts = ["ab", "abc", "bcd", "xyz", "é", "ü", "😀", "_", " ", "the", "other", "a" * 40]
    make = lambda n: "".join(draw.choice(parts) for _ in range(n))
    names = {make(draw.randint(1, 6)).strip() for _ in range(80)} | {"a" * 300, "a" * 260 + "b", "ab", "", "nowhere"}
    strings = [make(draw.randint(0, 30)) for _ in range(120)] + ["a" * 400, "x" + "a" * 260 + "b" + "c" * 300, "", "ab", "abc", make(900)]
    docs = [(i // 3, f'{i} "{a}" and "{b}" 12') for i, (a, b) in enumerate(zip(strings, strings[1:]))]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    found = lit.names_in_strings(d, n, within="substring")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.doc_id, k.at): k.name for r in found.collect() for k in r.known}
    want = {}
    for i, (a, b) in enumerate(zip(strings, strings[1:])):
        for at, value in ((1, a), (2, b)):
            held = sorted(x for x in names if len(x) > 2 and x in value)
            if held:
                want[i, at] = held[0]
    assert got == want


def test_hot_grams_are_spread(spark, monkeypatch):
    from cloakframe.operators import lookups

    monkeypatch.setattr(lookups, "HOT_FLOOR", 3)
    d = spark.createDataFrame([(i, f'say "the same {i % 7} theme" twice') for i in range(300)], "doc_id long, text string")
    n = spark.createDataFrame([("the",), ("heme",), ("6 th",), ("absent",)], "name string")
    got = {r.doc_id: r.known[0].name for r in lit.names_in_strings(d, n, within="substring").collect()}
    assert got == {i: "6 th" if i % 7 == 6 else "heme" for i in range(300)}
