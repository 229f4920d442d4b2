"""Names of a stored table meet the dictionary where they lie; only the rare ones are shuffled with their places."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import dictionary as dic
from cloakframe.operators import extract, lookups, masking
from cloakframe.session import materialize
from cloakframe.sources.corpus import write_masked

KEYS = ["kind", "name"]


@pytest.mark.parametrize("share", [1, 20, 500_000])
def test_stored_lookup_equals_a_plain_join(spark, monkeypatch, share):
    monkeypatch.setattr(lookups, "FREQUENT_SHARE", share)
    name = F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 50 != 1, F.concat(F.lit("k"), F.col("id") % 400))
    facts = spark.range(3000).select("id", F.lit("v").alias("kind"), name.alias("name"))
    once = facts.select(*KEYS).distinct().where("name <> 'k7'").withColumn("token", F.length("name"))
    table = once.unionByName(once.where("name IN ('often', 'k8')").withColumn("token", F.col("token") + 100))
    weights = lookups.row_weights(facts, KEYS)
    got, want = lookups.lookup_stored(facts, table, KEYS, weights), facts.join(table, KEYS)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_no_rows_at_all(spark):
    facts = spark.createDataFrame([], "id long, kind string, name string")
    table = facts.select(*KEYS, F.lit("t").alias("token"))
    assert lookups.lookup_stored(facts, table, KEYS, lookups.row_weights(facts, KEYS)).isEmpty()


def test_frequent_names_are_not_shuffled_to_the_dictionary(spark, texts, monkeypatch):
    """A name in every document and one in a single document: at a share of 1/3 only the first is frequent."""
    monkeypatch.setattr(lookups, "FREQUENT_SHARE", 3)
    docs = texts(*["often"] * 40, "rare often")
    found = materialize(extract.symbols(docs, "prose"), "bindings")
    entries = dic.build_dictionary(found)
    frame = masking.resolve(found, entries, stored=True)
    assert len(frame.collect()) == 42
    assert "BroadcastHashJoin [kind" in frame._jdf.queryExecution().executedPlan().toString()
    out = masking.rename(docs, found, entries, count_as="n", stored=True).orderBy("doc_id").collect()
    assert [(r["text"], r["n"]) for r in out] == [("gv_001", 1)] * 40 + [("gv_002 gv_001", 2)]


def test_masked_texts_are_written_compactly(texts, tmp_path):
    write_masked(texts("a"), str(tmp_path / "out"), "docs")
    names = [p.name for p in (tmp_path / "out").glob("*.parquet")]
    assert names and all(n.endswith(".zstd.parquet") for n in names)
