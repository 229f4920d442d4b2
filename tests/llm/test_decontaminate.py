"""Decontamination against a plain search of every window."""

import random
import re

from cloakframe.llm import decontaminate
from cloakframe.llm.queries import ORACLES, op8_decontaminate
from tools.check_oracles import connect, rows_of

SF = "/root/testdata/sf0.001"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    named |= found
        out.append((doc, len(w), len(hit), sorted(str(n) for n in named if n is not None)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=repr)


def cases():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ünd", "x9"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.randint(1, 60))) for i in range(30)] + [(40, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (41, "one"), (41, "Two three"), (42, None), (43, " - "), (None, "only here")]
    docs = []
    for i in range(80):
        parts = [text(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):
            w = words(draw.choice(items)[1])
            a = draw.randint(0, max(0, len(w) - 3))
            parts += [" ".join(w[a : a + draw.randint(3, 40)]).upper(), text(draw.randint(0, 12))]
        docs.append((i, ", ".join(parts)))
    docs += [(90, None), (91, ""), (92, "w1 " * 40), (93, "only, HERE one"), (93, "again under one id"), (None, "two! three")]
    return docs, items


def test_random_texts(spark):
    docs, items = cases()
    assert run(spark, docs, items) == plain(docs, items)


def test_large_benchmark_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = cases()
    assert run(spark, docs, items) == plain(docs, items)


def test_query_equals_sql(spark):
    df = op8_decontaminate(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = connect(SF).execute(ORACLES["op8_decontaminate"])
    assert got == rows_of([d[0] for d in relation.description], relation.fetchall())


def test_odd_and_empty(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "text under the same id")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    kept = decontaminate.drop_contaminated(odd_documents, items)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 1
    assert decontaminate.drop_contaminated(odd_documents, none).count() == odd_documents.count()
    assert decontaminate.contamination(no_documents, items).collect() == []
