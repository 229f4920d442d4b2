"""Isolation over a corpus: own and far stubs, hops, misses, and the row-local form."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import isolation, lookups, sections

PY_A = "import os\n\nclass Shop:\n    def price(self, rate):\n        if rate:\n            return helper(rate) + far(rate) + nowhere(rate)\n        return 0\n\ndef helper(x):\n    return deep(x)\n\ndef deep(x):\n    return far(x)\n"
PY_B = "def far(a,\n        b=0):\n    return helper(a) + farther(b)\n\ndef helper(y):\n    return y\n"
PY_C = "def farther(z):\n    return price(z)\n"
CPP = "#include <map>\nstruct Box { int v; };\nint total(Box b) {\n  return helper(b.v);\n}\nint helper(int x) { return x; }\n"
SCHEMA = "doc_id long, text string, language string, target string"


def corpus(spark, target):
    rows = [(1, PY_A, "python", target), (2, PY_B, "python", None), (3, PY_C, "python", None), (4, CPP, "cpp", "total"), (5, "no code", "text", "x"), (6, None, "python", "far")]
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


TAIL = "# Target function\ndef price(self, rate):\n    if rate:\n        return helper(rate) + far(rate) + nowhere(rate)\n    return 0"
HEAD = "import os\n\n# Class context (stub)\nclass Shop:  # stub\n    pass\n\n# Dependency stubs\n"
OWN = "def helper(x):\n    pass  # stub\n"
FAR = "def far(a,\n        b=0):\n    pass  # stub\n"


@pytest.mark.parametrize("floor", [100_000, 0])
def test_hops(spark, monkeypatch, floor):
    monkeypatch.setattr(lookups, "HOT_FLOOR", floor)
    expected = {
        1: HEAD + OWN + FAR + "\n" + TAIL,
        2: HEAD + OWN + "def deep(x):\n    pass  # stub\n" + FAR + "def helper(y):\n    pass  # stub\ndef farther(z):\n    pass  # stub\n\n" + TAIL,
    }
    expected[None] = expected[2]  # farther calls price, which is the target
    for hops, want in expected.items():
        out, missed = isolation.isolate_corpus(corpus(spark, "price"), "target", "language", hops)
        got = texts_of(out)
        assert got[1] == want
        assert got[2] == PY_B and got[3] == PY_C and got[5] == "no code" and got[6] is None
        assert got[4] == "#include <map>\n\n// Type declarations (stubs)\nstruct Box; // stub\n\n// Dependency stubs\nint helper(int x);\n\n// Target function\nint total(Box b) {\n  return helper(b.v);\n}"
        assert {r.doc_id: r.isolated for r in out.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
        assert {(r.doc_id, r.symbol) for r in missed.collect()} == {(5, "x"), (6, "far")}


def test_one_document_equals_the_row_local_form(spark):
    docs = spark.createDataFrame([(1, PY_B, "python", "far"), (2, PY_A.replace("far(", "near("), "python", "price"), (3, CPP, "cpp", "total")], SCHEMA)
    alone = docs.where("doc_id <> 1")
    out, _ = isolation.isolate_corpus(alone, "target", "language")
    for language in ("python", "cpp"):
        rows = alone.where(F.col("language") == language)
        assert texts_of(rows.withColumn("text", sections.isolate_of(F.col("text"), F.col("target"), language))) == {
            k: v for k, v in texts_of(out).items() if k in {r.doc_id for r in rows.collect()}
        }


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    out, missed = isolation.isolate_corpus(docs, "target", "language", None)
    assert out.collect() == [] and missed.collect() == []
