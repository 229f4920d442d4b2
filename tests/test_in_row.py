"""Frequent names and tokens are looked up inside the row of a text."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import dictionary as dic
from cloakframe.operators import extract, lookups, masking
from cloakframe.operators import unmask as un
from cloakframe.plans.mask import mask
from cloakframe.session import materialize

TEXTS = ["red fox, red hen: if the blue fox", "blue hen (red) é__x _ __fox__", "", None, "the lone word red", "red fox, red hen: if the blue fox"]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def docs(spark):
    ids = [1, 2, 3, 4, None, 1]  # one row comes twice, one has no id
    return spark.createDataFrame(list(zip(ids, range(6), TEXTS)), "doc_id long, kept int, text string")


def _rows(frame):
    return sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=repr)


@pytest.mark.parametrize("share", [1, 6, 500_000])
def test_names_looked_up_in_the_row_give_the_same_texts(spark, docs, monkeypatch, share):
    monkeypatch.setattr(lookups, "FREQUENT_SHARE", share)
    found = materialize(extract.symbols(docs, "prose"), "some")
    entries = dic.build_dictionary(found)
    twice = entries.unionByName(entries.where("original = 'hen'").withColumn("token", F.lit("gv_900")))
    odd = twice.unionByName(entries.where("original = 'fox'").withColumn("original", F.lit("if")).withColumn("token", F.lit("gv_901")))
    for given in (entries, odd):
        want = masking.rename(docs, found, given, count_as="n", stored=True)
        got = masking.rename_all(docs, found, given, count_as="n")
        assert _rows(got) == _rows(want)
        assert _rows(masking.rename_all(docs, found, given)) == _rows(want.drop("n"))


@pytest.mark.parametrize("share", [1, 6, 500_000])
def test_tokens_looked_up_in_the_row_give_the_same_texts(spark, monkeypatch, share):
    monkeypatch.setattr(lookups, "FREQUENT_SHARE", share)
    rows = [
        (1, "a", "gv_001 gv_002, gv_001 gv_404 word gv_005"), (2, "b", "gv_003gv_001 gv_002"), (3, None, "gv_001"), (4, "a", ""),
        (5, "b", None), (None, "a", "gv_001"), (1, "a", "gv_001 gv_002, gv_001 gv_404 word gv_005"), (6, "a", "no_token here gv_004"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, map string, text string")
    entries = [("gv_001", "rate", 9), ("gv_002", "fee", 3), ("gv_003", "x", None), ("gv_004", None, 5), ("gv_005", "p", 4), ("gv_005", "q", 1), ("word", "no", 8), (None, "n", 7)]
    given = spark.createDataFrame(entries, "token string, original string, n_docs long")
    for options in ({}, {"mark_unknown": False}):
        assert _rows(un.unmask(docs, given, **options)) == _rows(un.unmask(docs, given.drop("n_docs"), **options))
    maps = given.withColumn("map", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("original", F.concat("map", "original"))
    assert _rows(un.unmask(docs, maps, map_col="map")) == _rows(un.unmask(docs, maps.drop("n_docs"), map_col="map"))


def test_the_table_is_part_of_the_projection_and_no_column(spark, docs):
    """As a column of its own it would be copied into every row."""
    found = materialize(extract.symbols(docs, "prose"), "some")
    entries = dic.build_dictionary(found)
    masked = masking.rename_all(docs, found, entries, count_as="n")
    back = un.unmask(masked, entries)
    for plan in map(_plan, (masked.select("doc_id", F.sha2("text", 256)), back, back.select("doc_id", F.sha2("text", 256), "n_restored"))):
        assert "scalar-subquery" in plan and "AS _table" not in plan


def test_frequent_tokens_are_not_written(spark, monkeypatch):
    """Only the places of the others are, with a number for the rest."""
    monkeypatch.setattr(lookups, "FREQUENT_SHARE", 4)
    written = {}
    keep = lambda df, label, codec=None: written.setdefault(label, materialize(df, label, codec))
    monkeypatch.setattr(un, "materialize", keep)
    docs = spark.createDataFrame([(i, "gv_001 gv_001 gv_002") for i in range(8)], "doc_id long, text string")
    entries = spark.createDataFrame([("gv_001", "rate", 8), ("gv_002", "fee", 1)], "token string, original string, n_docs long")
    out = un.unmask(docs, entries).collect()
    assert {r.text for r in out} == {"rate rate fee"} and {r.n_restored for r in out} == {2}
    tokens = written["tokens"].collect()
    assert {(r.n, tuple(s["key"] for s in r.slots)) for r in tokens} == {(1, ("gv_002",))}


def test_masked_texts_of_level_2_are_a_written_table(spark, docs):
    for level in (2, 4):
        plan = _plan(mask(docs.where("doc_id IS NOT NULL"), level=level).docs)
        assert "Join" not in plan and "Relation" in plan
