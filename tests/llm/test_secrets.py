"""Secret scan: candidates against a plain search, features against a plain version, results on findings of the tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import secrets
from cloakframe.llm.common import bounded_sample
from cloakframe.llm.queries import op10_secrets

SF = "/root/testdata/sf0.01"
PLAIN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}"


def test_candidates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = secrets.candidates(docs, "source").collect()
    want = {
        (r["doc_id"], m.start(), m.end(), m[0], r["text"][: m.start()][-40:], r["text"][m.end() :][:8], r["source"])
        for r in docs.collect() for m in re.finditer(PLAIN, r["text"] or "")
    }
    # The part before a candidate starts behind the candidate before it.
    assert {(r["doc_id"], r["start"], r["end"], r["value"], r["path"]) for r in got} == {(*w[:4], w[6]) for w in want}
    assert len(got) == len(want)
    by = {(w[0], w[1]): w for w in want}
    for r in got:
        w = by[r["doc_id"], r["start"]]
        assert w[4].endswith(r["before"]) and w[5].startswith(r["after"])


def test_features(spark):
    rows = [("AbC123+/xy==" * 2, "token = \"", "\" end", "src/test.py"), ("onthtionwhonattionnd", "a ", " b", "x")]
    found = spark.createDataFrame(rows, "value string, before string, after string, path string")
    odds = [float(i % 7) for i in range(29 * 29)]
    triples = [i % 2 for i in range(26**3)]
    got = {r["value"]: r for r in secrets.with_features(found, odds, triples).collect()}
    for value, before, after, path in rows:
        r = got[value]
        code = [26 if c.isdigit() else 27 if c.isupper() else ord(c) - 97 if c.islower() else 28 for c in value]
        kinds = ["0" if c.isdigit() else "B" if c.isupper() else "a" if c.islower() else "#" for c in value]
        assert r["x_changes"] == pytest.approx(sum(a != b for a, b in zip(kinds, kinds[1:])) / len(value))
        assert r["x_transition"] == pytest.approx(sum(odds[a * 29 + b] for a, b in zip(code, code[1:])) / len(value))
        letters = [(a, b, c) for a, b, c in zip(code, code[1:], code[2:]) if max(a, b, c) < 26]
        assert r["x_coverage"] == pytest.approx(sum(triples[(a * 26 + b) * 26 + c] for a, b, c in letters) / len(value))
        assert r["x_digits"] == pytest.approx(sum(c.isdigit() for c in value) / len(value))
        assert r["x_assigned"] == (before.startswith("token")) and r["x_closed"] == after.startswith('"')
        assert r["x_test_path"] == ("test" in path)


def test_query(spark):
    """Every assigned hash is found; words of the invented prose are removed."""
    got = op10_secrets(spark, SF).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assigned = {
        (d, m.start(1)): hashlib.sha256(m[1].encode()).hexdigest()
        for d, t in docs.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")
    }
    found = {(r.doc_id, r.start): (r.value_sha256, r.secret) for r in got.itertuples()}
    assert assigned and all(found[at] == (sha, True) for at, sha in assigned.items())
    words = [(r.doc_id, r.start) for r in got.itertuples() if docs[r.doc_id][r.start : r.end].isalpha()]
    assert sum(found[at][1] for at in words) <= 0.01 * len(words)


def test_given_findings(spark, odd_documents):
    rows = [(f"{hashlib.sha1(str(i).encode()).hexdigest()}", "token = \"", "\"", "a", 1) for i in range(60)]
    rows += [(f"{'thewordand' * 2}{chr(97 + i % 26)}{chr(97 + i // 26)}", " ", " ", "b", 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "value string, before string, after string, path string, label int")
    got = secrets.scan(odd_documents, "source", labelled).where("doc_id = 6").collect()
    assert [r["secret"] for r in got] == [True]


def test_odd_and_empty(odd_documents, no_documents):
    got = secrets.scan(odd_documents).collect()
    assert [r["doc_id"] for r in got] == [6] and got[0]["secret"]
    assert secrets.scan(no_documents).collect() == []
    assert secrets.scan(odd_documents.withColumn("source", F.lit(None).cast("string"))).count() == 1


ASSIGNED = [
    ("API_KEY=abcdef0123456789abcdef0123", ["abcdef0123456789abcdef0123"]),
    ("https://a.b/c?token=abcdef0123456789abcdef0123&x=1", ["abcdef0123456789abcdef0123"]),
    ("https://a.b/c?x=1&auth_token=abc.def-0123#top", ["abc.def-0123"]),
    ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]),
    ("password=hunter2hunter2", ["hunter2hunter2"]),
    ("password: 'S3cr3t!pass'", ["S3cr3t!pass"]),
    ('{"db_password" : "it\'s@1:$.x"}', ["it's@1:$.x"]),
    ("pwd := abc123, next", ["abc123"]),
    ("The secret: x1y2z3w4.", ["x1y2z3w4"]),
    ("Authorization: Bearer eyJh.eyJz.c2ln", ["eyJh.eyJz.c2ln"]),
    ("API_TOKEN=a1b2c3d4 API_SECRET=e5f6a7b8", ["a1b2c3d4", "e5f6a7b8"]),
    ("token = short; user=hunter2hunter2; the token was lost", []),
    ("password=${DB_PASSWORD}", []),
]


def test_assigned_values(spark):
    """Values behind a name, without quotation marks, short and with further signs."""
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(ASSIGNED)], "doc_id long, text string, source string")
    found = {}
    for r in secrets.candidates(df, "source").collect():
        text = ASSIGNED[r["doc_id"]][0]
        assert text[r["start"] : r["end"]] == r["value"] and r["before"] == text[max(0, r["start"] - 40) : r["start"]]
        found.setdefault(r["doc_id"], []).append((r["start"], r["value"]))
    said = {}
    for r in secrets.scan(df).where("secret").collect():
        said.setdefault(r["doc_id"], []).append((r["start"], ASSIGNED[r["doc_id"]][0][r["start"] : r["end"]]))
    for i, (text, want) in enumerate(ASSIGNED):
        names = [v for v in (x for _, x in sorted(found.get(i, []))) if v != "AWS_SECRET_ACCESS_KEY"]
        assert names == want, text
        assert [v for _, v in sorted(said.get(i, []))] == want, text


def test_triples_of_all_documents(spark):
    """Each of 3,000 documents has a triple of its own; none may be missed."""
    codes = [(i * 7919) % 26**3 for i in range(3000)]
    words = ["".join(chr(97 + c // d % 26) for d in (676, 26, 1)) for c in codes]
    df = spark.createDataFrame(list(enumerate(words)) + [(None, None)], "doc_id long, text string")
    got = secrets.word_triples(df)
    assert [t for t, known in enumerate(got) if known] == sorted(codes)


def test_sample_of_findings_with_a_hot_value(spark):
    """One value in 50,000 places: the bound holds, and rare values keep their share."""
    rows = spark.range(50_000).selectExpr("'hotvalue0123456789' value", "concat('token = ', id) before", "'' after", "'a' path", "1 label")
    rare = spark.range(100).selectExpr("concat('rare', id % 13) value", "concat('key = ', id) before", "'' after", "'b' path", "1 label")
    chosen = bounded_sample(rows.unionByName(rare), 4000)
    counts = {r["hot"]: r["count"] for r in chosen.groupBy((F.col("path") == "a").alias("hot")).count().collect()}
    assert 3600 < counts[True] + counts.get(False, 0) < 4400 and 1 <= counts.get(False, 0) < 25
