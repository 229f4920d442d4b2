"""Letters and blanks of a text, taken by the run."""

from pyspark.sql import functions as F

from cloakframe.plans.catalog import letters


def test_letters_are_those_left_when_others_are_taken_out(spark):
    texts = ["", " ", "a1b2", "été  No. 7\n\tend", "\U0001f600x\U0001f600 y", "...", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", letters(F.col("text")).alias("got"), F.regexp_replace("text", "[^A-Za-z ]", "").alias("want")
    )
    assert all(r.got == r.want for r in rows.collect())
