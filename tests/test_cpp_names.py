"""C++ made of texts: what is read once, and the names that leave a row together."""

from pyspark.sql import functions as F

from cloakframe.functions.arrays import firsts
from cloakframe.operators import extract
from cloakframe.operators.cpp_scopes import _LEAD, _bare, _stripped
from cloakframe.plans import catalog


def _rows(frame):
    return sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=repr)


def test_firsts_of_rows_with_and_without_equal_values(spark):
    rows = [("a", 1), ("b", 2), ("c", 3)]
    for given in (rows, [*rows, ("b", 4), ("a", 5)], [(None, 1), (None, 2), ("a", 3)], []):
        frame = spark.createDataFrame([(given,)], "x array<struct<k:string,n:int>>")
        want = {}
        for k, n in given:
            want.setdefault(k, n)
        got = frame.select(firsts(F.col("x"), "k").alias("f")).first().f
        assert {r.k: r.n for r in got} == want and len(got) == len(want)


def test_words_of_code_are_found_once_and_leave_their_row_by_scope(spark):
    docs = spark.createDataFrame([(1, "some first words, some more words"), (2, ""), (1, "more of first")], "doc_id long, text string")
    code = docs.withColumn("text", catalog.cpp_like(F.col("text")))
    assert code._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = catalog._names_by_scope(code, "cpp")
    one = code.select("doc_id", F.explode(extract.declared_symbols(F.col("text"), "cpp")).alias("s")).select("doc_id", "s.*")
    want = one.groupBy("doc_id", "kind", "scope").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256).alias("names_sha"))
    assert _rows(got) == _rows(want)
    exploded = code.select("doc_id", F.explode(extract.declared_symbols(F.col("text"), "cpp")).alias("s")).count()
    assert got.agg(F.sum("n")).first()[0] == exploded


def test_heads_lose_the_same_leads_and_blanks(spark):
    heads = ["", " ", "int x ", "public: int x\n", "\n template<class T> class A \t", "x ", "x  ", "x \u0085", "x\n ", "case 1: default: y", "a b  c", "é \n\n"]
    frame = spark.createDataFrame([(h,) for h in heads], "h string")
    new, old = _stripped(_bare(F.col("h"))), F.regexp_replace(F.regexp_replace("h", _LEAD, ""), r"\s+$", "")
    assert [tuple(r) for r in frame.select(new, old).collect() if r[0] != r[1]] == []
