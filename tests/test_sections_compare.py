import difflib
import random

from pyspark.sql import functions as F

from cloakframe.operators import compare, sections

from .conftest import column

CODE = """import os

class Shop:
    def price(self,
              rate, tax=0) -> float:
        if rate:
            return helper(rate)

        return tax

    def other(self):
        pass

def helper(x):
    return x
TOP = 1
"""
CPP = """#include <map>
class Box { int v; };
struct Unused { int v; };
int helper(int x) { return x; }
int total(Box b) {
  if (b.v) {
    return helper(b.v);
  }
  return 0;
}
int decl(int y);
"""


def test_python_sections(texts):
    rows = {r.name: r for r in sections.sections(texts(CODE), "python").collect()}
    assert set(rows) == {"price", "other", "helper"}
    assert rows["price"].signature == "def price(self,\n              rate, tax=0)"
    assert rows["price"].body.endswith("return tax") and (rows["price"].start_line, rows["price"].end_line) == (3, 10)
    assert rows["helper"].body == "def helper(x):\n    return x"


def test_cpp_sections_and_calls(texts):
    found = sections.sections(texts(CPP), "cpp")
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"helper", "total"}
    assert rows["total"].body.startswith("int total(Box b) {") and rows["total"].body.endswith("return 0;\n}")
    assert rows["total"].signature == "int total(Box b)"
    assert [(r.caller, r.callee) for r in sections.call_edges(found).collect()] == [("total", "helper")]


def test_hundred_thousand_headers(texts):
    python = "".join(f"def f{i}(a):\n    return a\n" for i in range(100_000))
    cpp = "".join(f"int f{i}(int a) {{\n  return a;\n}}\n" for i in range(100_000))
    # The empty line behind the last line break belongs to the last section of Python.
    for language, code, lines, exact in (("python", python, 2, 99_999), ("cpp", cpp, 3, 100_000)):
        found = sections.sections(texts(code), language).select("name", "start_line", "end_line")
        facts = found.agg(F.count("*"), F.sum("start_line"), F.count_if(F.col("end_line") - F.col("start_line") == lines)).first()
        assert tuple(facts) == (100_000, lines * 99_999 * 50_000, exact)


def test_nested_sections_and_odd_endings(texts):
    code = "def a(\n    x,\n):\n    def b(y):\n        pass\n\n    # note\n  \nz = 1\ndef c(\n"
    rows = [(r.name, r.start_line, r.end_line) for r in sections.sections(texts(code), "python").collect()]
    assert rows == [("a", 0, 8), ("b", 3, 6), ("c", 9, 11)]
    code = "int a(int x)\n{\n  if (x) { }\n}\nvoid b() { }\nint c();\nint d(int y) {\n"
    rows = [(r.name, r.start_line, r.end_line) for r in sections.sections(texts(code), "cpp").collect()]
    assert rows == [("a", 0, 4), ("b", 4, 5), ("d", 6, 8)]


def test_isolate(texts):
    cut = lambda code, name, lang: texts(code).select(sections.isolate_of(F.col("text"), F.lit(name), lang).alias("t")).head().t
    assert cut(CODE, "price", "python") == (
        "import os\n\n# Class context (stub)\nclass Shop:  # stub\n    pass\n\n# Dependency stubs\ndef helper(x):\n    pass  # stub\n\n"
        "# Target function\ndef price(self,\n          rate, tax=0) -> float:\n    if rate:\n        return helper(rate)\n\n    return tax"
    )
    assert cut(CPP, "total", "cpp") == (
        "#include <map>\n\n// Type declarations (stubs)\nclass Box; // stub\n\n// Dependency stubs\nint helper(int x);\n\n"
        "// Target function\nint total(Box b) {\n  if (b.v) {\n    return helper(b.v);\n  }\n  return 0;\n}"
    )
    assert cut(CODE, "missing", "python") is None


def _pair(spark, *pairs):
    sent = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs, 1)], "doc_id long, text string")
    received = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs, 1)], "doc_id long, text string")
    return sent, received


def test_six_kinds_of_change_and_scores(spark):
    f = lambda name, body="pass", args="": f"def {name}({args}):\n    {body}\n"
    pairs = [
        (f("a"), f("a")),
        (f("a"), f("a", "return 1")),
        (f("a"), f("a", args="x")),
        (f("a"), f("b")),
        (f("a"), "import os\n" + f("a", "gv_001")),
        (f("a"), f("a") + "".join(f(f"n{i}") for i in range(7))),
        (f("a"), f("a") + f("n1") + "gv_001\n"),
        (f("a"), f("a") + f("n1") + "import os\nimport re\n"),
        (f("a") + f("b"), f("a", "x") + f("n1") + f("n2") + "gv_001\ngv_002\n"),
    ]
    sent, received = _pair(spark, *pairs)
    changes = compare.changes(sent, received, "python")
    kinds = {}
    for r in changes.collect():
        kinds.setdefault(r.doc_id, set()).add((r.type, r.name))
    assert 1 not in kinds
    assert kinds[2] == {("modified", "a")}
    assert kinds[3] == {("signature_change", "a")}
    assert kinds[4] == {("new_function", "b"), ("deleted_function", "a")}
    assert kinds[5] == {("modified", "a"), ("new_variable", "gv_001"), ("new_dependency", "import os")}
    got = {r.doc_id: (r.score, r.confidence) for r in compare.confidence(received, changes).collect()}
    assert got == {
        1: (100, "HIGH"),
        2: (95, "HIGH"),
        3: (90, "HIGH"),
        4: (65, "MEDIUM"),
        5: (87, "HIGH"),
        6: (0, "LOW"),
        7: (80, "HIGH"),
        8: (79, "MEDIUM"),
        9: (35, "LOW"),
    }


def _expected_blocks(old, new):
    """Blocks by a diff of the lines, those at most one line apart merged."""
    a, b = old.splitlines(), new.splitlines()
    blocks = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        if blocks and j1 - blocks[-1][1] <= 1:
            blocks[-1][1] = j2
        else:
            blocks.append([j1, j2])
    return [tuple(x) for x in blocks]


def test_change_blocks_match_a_diff_when_no_line_moves(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(25):
        old = [f"line {i}" for i in range(rng.randrange(1, 30))]
        new = []
        for i, line in enumerate(old):
            action = rng.random()
            if action < 0.15:
                continue
            new.append(f"changed {i}" if action < 0.3 else line)
            if action > 0.9:
                new.append(f"extra {i}")
        pairs.append(("\n".join(old), "\n".join(new) or "x"))
    got = {}
    for r in compare.change_blocks(*_pair(spark, *pairs)).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.start_line, r.end_line))
    for i, (old, new) in enumerate(pairs, 1):
        assert got.get(i, []) == _expected_blocks(old, new), (old, new)


def test_block_types_and_gaps(spark):
    base = "a\nb\nc\nd\ne\nf"
    pairs = [
        (base, "a\nx\nb\nc\nd\ne\nf"),
        (base, "a\nb\nd\ne\nf"),
        (base, "a\nX\nc\nd\ne\nf"),
        (base, "a\nX\nc\nY\ne\nf"),
        (base, "a\nX\nc\nd\nY\nf"),
        (base, base),
    ]
    got = {}
    for r in compare.change_blocks(*_pair(spark, *pairs)).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.block_type, r.original_lines, r.new_lines))
    assert got == {
        1: [("added", [], ["x"])],
        2: [("deleted", ["c"], [])],
        3: [("modified", ["b"], ["X"])],
        4: [("modified", ["b", "c", "d"], ["X", "c", "Y"])],
        5: [("modified", ["b"], ["X"]), ("modified", ["e"], ["Y"])],
    }


def test_descriptions(spark):
    cases = [
        ([], ["def helper(x):", "  pass"], "new helper function 'helper'"),
        ([], ["int sum(int a) {", "}"], "new helper function 'sum'"),
        ([], ["import os", "", "from a import b"], "added dependency: import os, from a import b"),
        ([], ["x = 1", "try:"], "error handling"),
        ([], ["y = d.get(1)"], "null-safety check"),
        ([], ["if x:", "  y"], "added conditional check"),
        ([], ["x", "y"], "added 2 lines"),
        (["x", "y"], [], "removed 2 lines"),
        (["d[1]"], ["d.get(1)"], "null-safety check with .get()"),
        (["x"], ["try:", "  x"], "error handling"),
        (["x"], ["if y:", "  x"], "wrapped in conditional check"),
        (["a + b"], ["a - b"], "changed '+' to '-'"),
        (["x", "y"], ["def h(a):", "  x"], "new helper function 'h'"),
        (["x", "z"], ["import re", "y"], "added dependency: import re"),
        (["x", "z"], ["q", "y"], "modified 2 lines"),
    ]
    rows = [(i, o, n) for i, (o, n, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, o array<string>, n array<string>")
    got = {r.i: r.d for r in df.select("i", compare.describe_change(F.col("o"), F.col("n")).alias("d")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_annotations_stand_above_the_change(spark):
    sent, received = _pair(spark, ("def f():\n    return a + b\n# end", "def f():\n    return a - b\n# end"), ("x", "x"))
    out = compare.annotate_changes(received, compare.change_blocks(sent, received))
    assert column(out) == ["def f():\n    # --- AI MODIFIED: changed '+' to '-' ---\n    return a - b\n# end", "x"]
