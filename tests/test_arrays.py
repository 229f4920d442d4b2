import random
import re

import regex
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind, exclusive_sums, fill, located, pieces_of, slots, sql_first_below, sql_minima
from cloakframe.functions.patterns import WORD


def test_exclusive_sums_match_a_loop(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 15, 16, 17, 255, 256, 257, 3000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    got = {r.i: r.s for r in df.select("i", exclusive_sums(F.col("v")).alias("s")).collect()}
    for i, values in enumerate(rows):
        total, want = 0, []
        for v in values:
            want.append(total)
            total += v
        assert got[i] == want


def _random_text(rng, size):
    return "".join(rng.choice("ab é_1 \n.,'\"") for _ in range(size))


def test_located_matches_finditer(texts):
    rng = random.Random(2)
    samples = ["", "a", "\n", "a\nb", "é1 _x\n\n y"] + [_random_text(rng, n) for n in (10, 100, 2000)]
    df = texts(*samples).select("doc_id", located(F.col("text"), WORD).alias("l"))
    got = {r.doc_id: [tuple(x) for x in r.l] for r in df.collect()}
    for i, text in enumerate(samples, 1):
        want = []
        for n, m in enumerate(regex.finditer(r"[\p{L}\p{N}_]+", text)):
            before = text[: m.start()]
            want.append((m.group(), n, m.start(), m.end(), before.count("\n") + 1, m.start() - before.rfind("\n")))
        assert got[i] == want


def test_slots_and_fill_replace_every_place(texts):
    rng = random.Random(3)
    samples = [_random_text(rng, n) for n in (0, 5, 50, 500)]
    pattern = "[ab]+"
    found = slots(pieces_of(F.col("text"), pattern), lambda p: p != "b")
    filled = F.transform(found, lambda s: F.struct(F.upper(s["key"]).alias("value"), s["at"].alias("at")))
    got = [r.t for r in texts(*samples).orderBy("doc_id").select(fill(F.col("text"), pattern, filled).alias("t")).collect()]
    assert got == [re.sub("[ab]+", lambda m: m.group() if m.group() == "b" else m.group().upper(), t) for t in samples]


def test_fill_keeps_the_text_without_matches(texts):
    none = F.lit(None).cast("array<struct<value:string,at:array<int>>>")
    assert [r.t for r in texts("a b", "").select(fill(F.col("text"), WORD, none).alias("t")).collect()] == ["a b", ""]


def test_slots_handle_a_text_of_one_repeated_word(texts):
    text = "same " * 20_000
    row = texts(text).select(slots(pieces_of(F.col("text"), WORD)).alias("s")).head()
    assert [s.key for s in row.s] == ["same"] and row.s[0].at == list(range(20_000))


def test_first_below_equals_a_plain_search(spark):
    draw = random.Random(2)
    rows = []
    for n in (0, 1, 5, 31, 32, 33, 1023, 1025, 40_000):
        values = [draw.choice([3, 5, 9, 9, 9]) + (n > 1000) * draw.choice([0, 0, 0, 7]) for _ in range(n)]
        asked = [(draw.randrange(max(1, n)), draw.choice([0, 1, 4, 6, 20])) for _ in range(30)] + [(max(0, n - 1), 6), (n, 6), (0, 4)]
        rows.append((n, values, asked))
    df = spark.createDataFrame(rows, "n int, v array<int>, asked array<struct<at:int,bound:int>>")
    search = f"transform(s.asked, q -> {sql_first_below('m.v', 'q.at', 'q.bound')})"
    got = df.select("n", bind(sql_minima("m", search, v="s.v"), v=F.col("v"), asked=F.col("asked")).alias("found")).collect()
    found = {r["n"]: r["found"] for r in got}
    for n, values, asked in rows:
        want = [next((i for i in range(at, n) if values[i] < bound), None) for at, bound in asked]
        assert found[n] == want
