"""Pieces grouped and put back by numbers."""

from pyspark.sql import functions as F

from cloakframe.functions import arrays
from cloakframe.functions.arrays import bind, fill, firsts, groups, pieces_of, slots
from cloakframe.functions.patterns import WORD


def _as_dict(found):
    assert len({g["key"] for g in found}) == len(found)
    return {g["key"]: g["at"] for g in found}


def _plain(text):
    out = {}
    for i, word in enumerate(text.split()):
        out.setdefault(word, []).append(i)
    return out


def test_groups_hold_every_place_of_every_piece(spark):
    texts = ["", "a", "b a b a a", "é e é É", " ".join(f"w{i * i % 97}" for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    rows = docs.select("doc_id", groups(pieces_of(F.col("text"), WORD)).alias("g"), slots(pieces_of(F.col("text"), WORD)).alias("s")).collect()
    for row in rows:
        if row.doc_id == 99:
            assert row.g is None and row.s is None
            continue
        assert _as_dict(row.g) == _plain(texts[row.doc_id])
        assert [s["key"] for s in row.s] == sorted(_plain(texts[row.doc_id]), key=lambda w: w.encode())


def test_pieces_that_share_a_hash_stay_apart(spark):
    body = arrays._HASHED.replace("xxhash64(p)", "CAST(length(p) AS BIGINT) << 40")
    assert body != arrays._HASHED
    docs = spark.createDataFrame([("aa bb aa c bb d",), ("a bb a",)], "text string")
    for row in docs.select("text", bind(body, p=pieces_of(F.col("text"), WORD)).alias("g")).collect():
        assert _as_dict(row.g) == _plain(row.text)


def test_firsts_keep_the_first_row_of_a_name(spark):
    rows = spark.sql("SELECT array(named_struct('n', 'b', 'k', 1), named_struct('n', 'a', 'k', 2), named_struct('n', 'b', 'k', 0)) AS r")
    found = rows.select(firsts(F.col("r"), "n").alias("f")).first().f
    assert {(x["n"], x["k"]) for x in found} == {("b", 1), ("a", 2)}


def test_fill_with_places_named_once_twice_or_not_at_all(spark):
    given = "array<struct<value:string,at:array<int>>>"
    docs = spark.createDataFrame(
        [(1, [("X", [0, 2]), ("Y", [1])]), (2, [("Z", [0]), ("A", [0, 3])]), (3, []), (4, [(None, [1])]), (5, None)],
        f"doc_id long, f {given}",
    ).withColumn("text", F.lit("a b, c (d)"))
    found = {r.doc_id: r.t for r in docs.select("doc_id", fill(F.col("text"), WORD, F.col("f")).alias("t")).collect()}
    assert found == {1: "X Y, X (d)", 2: "A b, c (A)", 3: "a b, c (d)", 4: "a , c (d)", 5: "a b, c (d)"}
