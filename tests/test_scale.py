"""What keeps the jobs cheap: how pieces are sorted, how rows meet the dictionary, and what is shuffled."""

from pyspark.sql import functions as F

from cloakframe.functions.arrays import fill, pieces_of, slots
from cloakframe.functions.patterns import WORD
from cloakframe.operators.extract import prose_symbols
from cloakframe.operators.lookups import lookup, row_weights
from cloakframe.operators.masking import substitute


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_are_sorted_without_a_comparing_expression(texts):
    docs = texts("b a b", "")
    filled = F.transform(slots(pieces_of(F.col("text"), WORD)), lambda s: F.struct(s["key"].alias("value"), s["at"].alias("at")))
    for column in (slots(pieces_of(F.col("text"), WORD)), prose_symbols(F.col("text")), fill(F.col("text"), WORD, filled)):
        assert "array_sort(" not in plan(docs.select(column.alias("c"))).replace("sort_array(", "")


def test_slots_of_odd_texts(spark):
    rows = ["b a b if 7 b", "", "été été ete", None, "x " * 3000]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = docs.select("doc_id", slots(pieces_of(F.col("text"), WORD), lambda k: k != "if").alias("s")).collect()
    for row in found:
        text = rows[row["doc_id"]]
        if text is None:
            assert row["s"] is None
            continue
        words = text.split()
        assert [(s["key"], s["at"]) for s in row["s"]] == [
            (k, [i for i, w in enumerate(words) if w == k]) for k in sorted(set(words) - {"if"})
        ]


def test_lookup_does_not_sort_the_facts(spark):
    facts = spark.range(50).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(7).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    joined = lookup(facts, table, ["k"], "left", "id", row_weights(facts, ["k"]))
    assert "ShuffledHashJoin" in plan(joined) and "SortMergeJoin" not in plan(joined)
    assert joined.where("v IS NOT NULL").count() == 50


def test_values_are_collected_behind_the_shuffle(spark, texts):
    """Rows of one document come from all over the table: what is collected before the shuffle is sorted for nothing."""
    docs = texts("a b", "b")
    resolved = spark.createDataFrame([(1, "x", [0]), (1, "y", [1]), (2, "y", [0])], "doc_id long, value string, at array<int>")
    out = substitute(docs, resolved, WORD)
    lines = plan(out).split("\n")
    above = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(doc_id" in line and "REPARTITION" in line)
    assert max(i for i, line in enumerate(lines) if "collect_list" in line) < above
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "x y", 2: "y"}
