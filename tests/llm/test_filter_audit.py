"""The filter audit against a plain run of every order."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import filter_audit
from cloakframe.llm.queries import ORACLES, op13_filter_audit
from tools.check_oracles import connect, rows_of

SF = "/root/testdata/sf0.001"
ORDER = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def counts_of(text):
    words = text.encode().split()  # at the six blanks of ASCII only
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)


def failures(docs):
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    for doc, text, _ in docs:
        n, distinct, capitals, points, signs = counts_of(text or "")
        tests = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * points, signs > 0, doc is not None and doc > least[text or ""]]
        yield {f for f, hit in zip("ABCDE", tests) if hit}


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = list(zip(docs, failures(docs)))
    out = []
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(d[0], fails) for d, fails in rows if (d[2] or "") == part]
        first_of = {f: 0 for f in "ABCDE"}
        made = []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                first_of[f] += len(gone)
                redundant = sum(f in fails for _, fails in mine) - len(gone)
                only = sum(fails == {f} for _, fails in mine)
                made.append([part, "".join(order), step, len(left), len(gone), redundant, only, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
        out += [(*row, first_of[row[1][row[2] - 1]]) for row in made]
    return sorted(out, key=repr)


def run(docs, labels):
    return sorted((tuple(r) for r in filter_audit.interaction(docs, labels).select(*ORDER).collect()), key=repr)


def texts():
    draw = random.Random(5)
    words = ["a", "bb", "Ccc", "ünï", "eightcha", "ninechars", "sixteen_letters!", "seventeen_letters", "😀", "x y", "T" * 40, "#", "50%"]
    made = ["", " ", "\n\t", "a", " a", "a ", "ABC", " ", "é" * 9]
    for _ in range(120):
        some = draw.sample(words, draw.randint(1, len(words)))
        n = draw.choice([3, 99, 100, 101, 130])
        made.append(draw.choice([" ", "\n", " \x0b\f\r"]).join(draw.choice(some) + (str(draw.randint(0, 300)) if draw.random() < 0.8 else "") for _ in range(n)))
    return made


def test_pass_counts_like_a_plain_one():
    got = filter_audit.measured([t.encode() for t in texts()])
    assert [tuple(r) for r in got.tolist()] == [counts_of(t) for t in texts()]


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "span_hashes", lambda eights, starts, lengths, seeds: np.full(len(starts), 7, np.uint64))
    got = filter_audit.measured([t.encode() for t in texts()[:40]])
    assert [tuple(r) for r in got.tolist()] == [counts_of(t) for t in texts()[:40]]


def test_long_words_and_blocks(monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 50)
    given = ["w" * 100_000 + " " + "w" * 99_999 + "x " + "w" * 100_000] + texts()[:30]
    both = [int(m) for m in filter_audit.text_failures([t.encode() for t in given])]
    monkeypatch.setattr(filter_audit, "BLOCK", 1 << 30)
    assert both == [int(m) for m in filter_audit.text_failures([t.encode() for t in given])]
    assert filter_audit.measured([given[0].encode()])[0].tolist()[:2] == [3, 2]


def test_exact_limits():
    ten = " ".join(f"w{i}" for i in range(80)) + " w0" * 20  # 80 of 100 distinct: not below
    assert filter_audit.text_failures([ten.encode(), (ten + " w0").encode(), b"Abcdefghij", b"Abcdefghi"]).tolist() == [0, 2, 1, 5]


def test_random_rows(spark):
    draw = random.Random(6)
    given = texts()
    docs = [(draw.randint(0, 150), draw.choice(given), draw.choice(["en", "fr", "", None])) for _ in range(260)]
    docs += [(None, given[9], "en"), (None, None, "de"), (151, None, "de"), (152, "", "de"), (152, "", "de"), (153, given[9], "only")]
    labels = [(draw.randint(0, 160), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert run(d, y) == plain(docs, labels)


def test_query_equals_sql(spark):
    df = op13_filter_audit(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = connect(SF).execute(ORACLES["op13_filter_audit"])
    assert got == rows_of([d[0] for d in relation.description], relation.fetchall())


def test_odd_and_empty(odd_documents, no_documents, odd_labels):
    clash = odd_documents.withColumns({c: F.lit("x") for c in ("part", "fails", "n", "h1", "least")})
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd_documents.collect()]
    assert run(clash, odd_labels) == plain(docs, [tuple(r) for r in odd_labels.collect()])
    assert run(clash, odd_labels.where("false")) == plain(docs, [])
    assert run(no_documents, odd_labels) == []


@pytest.mark.parametrize("text", ["", "a", "😀".encode("utf-16", "surrogatepass").decode("utf-16")])
def test_one_text(text):
    assert tuple(filter_audit.measured([text.encode()])[0].tolist()) == counts_of(text)
