"""Phrases that guess are tried only at their first letters, in either case."""

from pyspark.sql import functions as F

from cloakframe.operators.annotate import SPECULATION, SPECULATION_ABOUT

SAID = {
    0: ["it MIGHT be so", "may have it", "could return x", "Probably throw it", "likely cause y", "Possibly be so"],
    1: ["i'm NOT sure", "It's unclear", "hard to tell", "Without seeing"],
    2: ["Assuming so", "IF I had to guess", "based on the name"],
    3: ["The implementation of foo", "INSIDE foo", "within `foo`"],
    4: ["make sure that foo", "Verify foo", "check foo", "ENSURE foo"],
}


def test_every_phrase_is_found(texts):
    for n, pattern in enumerate([*SPECULATION, *SPECULATION_ABOUT]):
        assert pattern.startswith("(?i)(?=[")
        found = texts(*SAID[n], "nothing of it").select("text", F.col("text").rlike(pattern).alias("hit")).collect()
        assert [r.text for r in found if r.hit] == SAID[n]
