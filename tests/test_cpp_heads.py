"""Heads of C++ functions are read up to their parenthesis, with the results of one pattern over the whole head."""

from pyspark.sql import functions as F

from cloakframe.functions.patterns import NAME, WORD_CHAR
from cloakframe.operators import cpp_scopes


def test_function_heads_are_read_up_to_their_parenthesis(spark):
    whole = rf"^([^=(]*?)(?<!{WORD_CHAR})((?:{NAME}\s*::\s*)*)(~?)({NAME})\s*\(([\s\S]*)$"
    heads = [
        "void run(const Part& p, int q = 2) const", "int a, b", "auto x = call(1, 2)", "Box :: Inner::~Box\n (int a)", "(a)", "", "f()",
        "a b\u2028(c)", "9f(x)", "std::vector<int> f_9(int (*g)(int))", "x == y (z)", "operator()(int a)", "int é(ü)", "run \n(\n)\n",
    ]
    head = F.col("head")
    rows = spark.createDataFrame([(h,) for h in heads], "head string").select(
        "head", head.rlike(whole).alias("old"), cpp_scopes._is_function(head).alias("new"),
        F.regexp_replace(F.regexp_replace(F.regexp_extract(head, whole, 2), r"\s+", ""), "::$", "").alias("old_owner"),
        cpp_scopes._qualifier(head).alias("new_owner"),
        F.regexp_extract(head, whole, 4).alias("old_name"), cpp_scopes._function_name(head).alias("new_name"),
        F.regexp_extract(head, whole, 5).alias("old_rest"), cpp_scopes._behind(head).alias("new_rest"),
    )
    for r in rows.collect():
        assert r.old == r.new, r.head
        if r.old:
            assert (r.old_owner, r.old_name, r.old_rest) == (r.new_owner, r.new_name, r.new_rest), r.head
