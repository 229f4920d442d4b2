"""Line dedup against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import line_dedup
from cloakframe.llm.queries import ORACLES, op11_line_dedup
from cloakframe.operators import lookups
from tools.check_oracles import connect, rows_of

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
LONG = [f"Line number {i} of the shared footer, É and Z, in all documents" for i in range(4)]


def key_of(line):
    return line.strip(" \t\n\x0b\f\r").translate(UPPER)


def plain(docs, least_chars=40, least_docs=5):
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                held.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in docs:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            ids = held.get(key_of(line), set())
            last = max((i for i in ids if i is not None), default=None)
            if len(ids) < least_docs or doc == last:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, docs, **how):
    made = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), **how)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in made.collect()), key=repr)


def cases():
    draw = random.Random(11)
    docs = []
    for i in range(60):
        lines = [draw.choice(["", " ", "short line", f"own text of document {i} that is long enough to count {draw.randint(0, 9)}"]) for _ in range(draw.randint(0, 6))]
        lines += [draw.choice(["", "  ", "\t"]) + (x.upper() if draw.random() < 0.3 else x) + draw.choice(["", " \r", "\x0b"]) for x in LONG if draw.random() < 0.5]
        draw.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    alike = "one line of forty code points, e with accent É or é"
    docs += [(100 + i, alike if i % 2 else alike.replace("É", "é")) for i in range(9)]  # É is not é: nine lines of two keys
    docs += [(200, None), (201, ""), (202, "\n"), (203, "\n".join([LONG[0]] * 50)), (None, LONG[0]), (None, LONG[1] + "\n" + LONG[0]), (3, LONG[0]), (3, LONG[0])]
    docs += [(300 + i, "x" * 39) for i in range(6)] + [(320 + i, " " + "y" * 39) for i in range(6)] + [(340 + i, "z" * 40) for i in range(4)]
    return docs


def test_random_texts(spark):
    assert run(spark, cases()) == plain(cases())


@pytest.mark.parametrize("chars,docs", [(1, 2), (40, 1), (0, 3), (60, 5)])
def test_other_thresholds(spark, chars, docs):
    assert run(spark, cases(), least_chars=chars, least_docs=docs) == plain(cases(), chars, docs)


def test_hot_lines_are_split(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_FLOOR", 3)
    assert run(spark, cases()) == plain(cases())


def test_many_lines_of_one_text(spark):
    shared = [f"this line number {i} is shared by five documents at least" for i in range(30_000)]
    text = "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {i}"))
    docs = [(i, text) for i in range(5)]
    got = run(spark, docs)
    assert [(r[2], r[3]) for r in got] == [(60_000, 30_000)] * 4 + [(60_000, 0)]
    assert got[0][1] == "\n".join(f"own {i}" for i in range(30_000))


def test_query_equals_sql(spark):
    df = op11_line_dedup(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = connect(SF).execute(ORACLES["op11_line_dedup"])
    assert got == rows_of([d[0] for d in relation.description], relation.fetchall())


def test_main_path_is_native(spark):
    plan = op11_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_odd_and_empty(odd_documents, no_documents):
    clash = odd_documents.withColumns({"n_lines": F.lit("x"), "_dropped": F.lit(1), "_at": F.lit(2), "_hash_a": F.lit(3)})
    made = line_dedup.drop_repeated_lines(clash, least_chars=10, least_docs=2)
    assert made.columns == [c for c in clash.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    given = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in made.collect()), key=repr)
    assert got == plain(given, 10, 2)
    assert line_dedup.drop_repeated_lines(no_documents).collect() == []
