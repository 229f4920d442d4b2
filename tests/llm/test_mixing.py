"""Mixing: the SQL counterpart, the distribution and the shares reached."""

import math

from pyspark.sql import functions as F

from cloakframe.llm import mixing
from cloakframe.llm.queries import ORACLES, op6_mixing
from tools.check_oracles import connect, rows_of

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    df = op6_mixing(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = connect(SF).execute(ORACLES["op6_mixing"])
    assert got == rows_of([d[0] for d in relation.description], relation.fetchall())


def test_counts_follow_the_distribution_and_shares_the_targets(spark, monkeypatch):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("abcdefghi").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "rare").otherwise("rest").alias("source"),
    )
    targets = spark.createDataFrame([("hot", 1.0), ("rare", 2.0), ("rest", 1.0), ("absent", 5.0), (None, 1.0)], "source string, weight double")
    for limit in (10_000, 0):  # broadcast, then salted
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        out = mixing.mix(docs, targets)
        counts = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        for source, share in (("hot", 1 / 4), ("rare", 2 / 4), ("rest", 1 / 4)):
            assert abs(counts[source] / total - share) < 0.03
        each = out.where("source = 'hot'").groupBy("doc_id").count().select("count").toPandas()["count"]
        mean = counts["hot"] / 2000
        drawn = [2000 - len(each)] + [int((each == k).sum()) for k in range(1, 6)]
        for k, n in enumerate(drawn):
            p = math.exp(-mean) * mean**k / math.factorial(k)
            assert abs(n / 2000 - p) < 0.04
        # The rare source is repeated dozens of times: its mean is drawn in parts.
        assert counts["rare"] / 40 > mixing.PIECE


def test_same_on_any_partitioning(spark):
    docs = spark.range(500).selectExpr("id doc_id", "concat('t', id) text", "cast(id % 4 as string) source")
    a = {(r["doc_id"], r["copy_no"], r["shuffle_key"]) for r in mixing.mix(docs).collect()}
    assert a == {(r["doc_id"], r["copy_no"], r["shuffle_key"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert len({k for _, _, k in a}) == len(a)


def test_odd_and_empty(odd_documents, no_documents):
    inner = {c: F.lit(c) for c in ("_name", "_salt", "_parts", "_steps", "_copies")}
    out = mixing.mix(odd_documents.withColumn("copy_no", F.lit("clash")).withColumns(inner))
    assert set(odd_documents.columns) | {"copy_no", "shuffle_key"} | set(inner) == set(out.columns)
    assert all(r[c] == c for r in out.collect() for c in inner)
    assert mixing.mix(no_documents).collect() == []
