import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cloakframe.functions.patterns import KIND_PREFIX
from cloakframe.operators import dictionary as dic
from cloakframe.operators import lookups

SCHEMA = "doc_id long, name string, kind string, scope string"


def _symbols(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_numbering_equals_one_window_per_prefix(spark):
    rows = [(i, f"n{i * 7919 % 2500}", k, "s" if i % 3 else "") for i in range(6000) for k in ("variable", "function")]
    symbols = _symbols(spark, rows)
    got = dic.build_dictionary(symbols)
    w = Window.partitionBy("prefix").orderBy("kind", "scope", "original")
    want = dic.distinct_symbols(symbols).withColumn("prefix", dic.prefix_of(F.col("kind"))).withColumn(
        "seq", F.row_number().over(w).cast("bigint")
    )
    columns = ["prefix", "seq", "original", "kind", "scope", "n_docs"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty()
    assert got.count() == want.count() == got.select("token").distinct().count()


def test_tokens_widen_past_three_digits(spark):
    got = dic.build_dictionary(_symbols(spark, [(1, f"n{i:05d}", "string", "") for i in range(1001)]))
    tokens = {r.seq: r.token for r in got.where("seq in (1, 999, 1000)").collect()}
    assert tokens == {1: "gs_001", 999: "gs_999", 1000: "gs_1000"}


def test_every_kind_has_its_prefix_and_unknown_ones_a_warning(spark):
    kinds = [*KIND_PREFIX, "odd"]
    symbols = _symbols(spark, [(1, k, k, "") for k in kinds])
    got = {r.kind: r.prefix for r in dic.build_dictionary(symbols).collect()}
    assert got == {**KIND_PREFIX, "odd": "gx"}
    assert [(r.symbol, r.type) for r in dic.warnings(symbols).collect()] == [("odd", "unknown_kind")]


def test_same_name_in_two_scopes_gets_two_tokens(spark):
    got = dic.build_dictionary(_symbols(spark, [(1, "x", "variable", "a"), (2, "x", "variable", "b"), (3, "x", "variable", "a")]))
    assert {(r.token, r.scope, r.n_docs) for r in got.collect()} == {("gv_001", "a", 2), ("gv_002", "b", 1)}
    assert [r.token for r in dic.reverse_map(got).collect()] == ["gv_002"]


def test_merge_keeps_tokens_and_is_stable(spark):
    first = dic.build_dictionary(_symbols(spark, [(1, "b", "variable", ""), (1, "f", "function", "")]))
    more = _symbols(spark, [(2, "a", "variable", ""), (2, "b", "variable", ""), (2, "K", "class", "")])
    merged = dic.merge_dictionary(first, more)
    assert {(r.token, r.original, r.n_docs) for r in merged.collect()} == {
        ("gv_001", "b", 2),
        ("gf_001", "f", 1),
        ("gv_002", "a", 1),
        ("gt_001", "K", 1),
    }
    again = dic.merge_dictionary(merged, more)
    assert {(r.token, r.original) for r in again.collect()} == {(r.token, r.original) for r in merged.collect()}


def test_files_are_rows(spark):
    rows = spark.createDataFrame(
        [("f1", "x", "variable", ""), ("f2", "x", "variable", ""), ("f2", "x", "variable", ""), ("f2", "y", "variable", "")],
        "file string, name string, kind string, scope string",
    )
    entries = dic.build_dictionary(rows)
    got = {(r.token, r.file) for r in dic.symbol_files(rows, entries, "file").collect()}
    assert got == {("gv_001", "f1"), ("gv_001", "f2"), ("gv_002", "f2")}


def test_hover_text_for_known_and_unknown_tokens(spark, texts):
    entries = dic.build_dictionary(_symbols(spark, [(1, "rate", "parameter", "f")]))
    found = dic.tokens_in(texts("gv_001 gf_123 gv_12 xgv_001 gv_001's"))
    got = {(r.token, r.n, r.hover) for r in dic.describe_tokens(found, entries).collect()}
    assert got == {("gv_001", 2, "gv_001 → rate · parameter · f"), ("gf_123", 1, "gf_123 (Function)")}
    assert [r.token for r in dic.collisions(texts("gv_001 gf_123"), entries).collect()] == ["gv_001"]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_lookup_equals_a_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(lookups, "HOT_FLOOR", 10)
    monkeypatch.setattr(lookups, "HOT_SHARE", 20)
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("key")
    )
    table = facts.select("key").distinct().where("key <> 'k7'").withColumn("v", F.length("key"))
    weights = lookups.row_weights(facts, ["key"])
    assert [r.key for r in lookups.hot_keys(weights, ["key"], "n_docs").collect()] == ["hot"]
    got = lookups.lookup(facts, table, ["key"], how, "id", weights)
    want = facts.join(table, ["key"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_browse_order(spark):
    entries = dic.build_dictionary(
        _symbols(spark, [(1, "f", "function", ""), (1, "s", "string", ""), (1, "v", "field", "C"), (1, "o", "odd", "")])
    )
    got = [(r.category, r.token, r.scope) for r in dic.browse(entries).collect()]
    assert got == [
        ("Variables", "gv_001", "C"),
        ("Functions", "gf_001", "(global)"),
        ("Strings", "gs_001", "(global)"),
        ("Other", "gx_001", "(global)"),
    ]


def test_tokens_are_numbered_past_look_alikes(spark, texts):
    from cloakframe.operators.dictionary import look_alikes, taken_numbers
    from cloakframe.plans.mask import mask, restore

    docs = texts(
        "def work(first):\n    kept = gv_001 + gf_007 + first\n",
        "other = gv_004\n# gs_002\n",
        "x_gv_900 = gv_9999999999999 + gv_90\n",
    )
    assert {(r["prefix"], r["taken"]) for r in taken_numbers(look_alikes(docs)).collect()} == {("gv", 4), ("gf", 7), ("gs", 2)}
    out = mask(docs, level=1, language="python")
    assert out.dictionary.where("prefix = 'gv' AND seq <= 4").isEmpty()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in restore(out).collect()}
    assert after[1] == before[1] and after[3] == before[3]
    prose = mask(docs, level=1, language="prose")
    assert {r["doc_id"]: r["text"] for r in restore(prose).collect()} == before


def test_turns_of_long_conversations_keep_apart(spark, tmp_path):
    from cloakframe.plans import catalog

    rows = spark.range(3000).selectExpr("id % 2 conv_id", "id div 2 turn", "'user' role", "concat('text ', id) text")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.turns(spark, str(tmp_path))
    assert got.select("turn_id").distinct().count() == 3000
