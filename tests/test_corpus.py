"""The mixed-language job: one numbering, comments, the policy's word on encryption and audit."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import policy
from cloakframe.plans import corpus
from cloakframe.sources.dictionary_store import decrypt_dictionary

FILES = [
    (1, "a.py", "def shared(first):\n    # Note of alpha\n    return first\n", 1, None),
    (2, "b.cpp", "int shared(int first) { /* why */ return first; }\n", 1, None),
    (3, "c.md", "shared words about first things", 1, None),
    (4, "d.py", "def other(x):\n    return shared(x)\n", 3, "missing"),
    (5, "e.py", "def outer(x):\n    return shared(x)\n\ndef idle(y):\n    return y\n", 3, "outer"),
    (6, "f", "nothing", 1, None),
    (7, "g.py", None, 2, None),
    (8, "h.py", "", 4, "x"),
]
SCHEMA = "doc_id long, path string, text string, level int, section string"


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, SCHEMA)


def policies(spark, **more):
    row = {"tier": "repo", **dict.fromkeys(("min_scrub_level", "default_scrub_level", "block_level_1", "enforce_audit", "encrypt_maps", "banned_patterns")), **more}
    return spark.createDataFrame([row], policy.POLICY_SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_one_numbering_over_all_languages(spark, files):
    out = corpus.mask_corpus(files, policies(spark), section_col="section")
    got = texts_of(out.docs)
    token = {(r.kind, r.scope, r.original): r.token for r in out.dictionary.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8} and got[7] is None and got[8] == ""
    f, first = token["function", "", "shared"], token["parameter", "shared", "first"]
    assert got[1] == f"def {f}({first}):\n    return {first}\n"
    assert got[2] == f"int {f}(int {first}) {{ return {first}; }}\n"
    # The file that was cut keeps its target and a stub of what it calls in another file.
    outer, x = token["function", "", "outer"], token["parameter", "outer", "x"]
    assert got[5] == f"def {f}({first}):\n    pass\n\ndef {outer}({x}):\n    return {f}({x})"
    assert "idle" not in str(token)
    assert {(r.doc_id, r.symbol) for r in out.warnings.collect()} == {(4, "missing"), (8, "x")}
    back = texts_of(corpus.restore_corpus(out))
    assert back[3] == FILES[2][2] and back[1] == "def shared(first):\n    return first\n"
    reasons = {r.doc_id: r.reason for r in out.decisions.where("status = 'rejected'").collect()}
    assert reasons == {6: "unsupported file type ''"}


def test_kept_comments_and_a_given_dictionary(spark, files):
    first = corpus.mask_corpus(files.where("doc_id = 2"), policies(spark))
    out = corpus.mask_corpus(files.where("doc_id < 4"), policies(spark), dictionary=first.dictionary, keep_comments=True)
    assert texts_of(corpus.restore_corpus(out)) == {i: t for i, _, t, _, _ in FILES[:3]}
    assert all("alpha" not in t and "why" not in t for t in texts_of(out.docs).values())
    old = {r.original: r.token for r in first.dictionary.collect()}
    kept = {(r.original, r.token) for r in out.dictionary.collect()}
    assert set(old.items()) <= kept


def test_written_as_the_policy_asks(spark, files, tmp_path):
    strict = policies(spark, encrypt_maps=True, enforce_audit=True, banned_patterns=["*.cpp"])
    out = corpus.mask_corpus(files, strict)
    with pytest.raises(ValueError):
        corpus.write_corpus(out, str(tmp_path / "none"))
    home = str(tmp_path / "job")
    corpus.write_corpus(out, home, "a passphrase")
    stored = spark.read.parquet(f"{home}/dictionary")
    assert "original" not in stored.columns
    plain = {r.original for r in decrypt_dictionary(stored, "a passphrase").collect()}
    assert "shared" in plain
    entries = spark.read.parquet(f"{home}/audit")
    assert {(r.f, r.scrub_level) for r in entries.select(F.element_at("source_files", 1).alias("f"), "scrub_level").collect()} == {
        (p, level) for i, p, _, level, _ in FILES if i not in (2, 6)
    }


def test_empty(spark):
    out = corpus.mask_corpus(spark.createDataFrame([], SCHEMA), policies(spark), section_col="section")
    assert out.docs.collect() == [] and out.decisions.collect() == [] and out.dictionary.collect() == []
