from cloakframe.operators import unmask as un

from .conftest import column

ENTRIES = [("gv_001", "rate"), ("gv_0010", "odd"), ("gf_001", "price_of"), ("gv_1000", "late")]


def _entries(spark):
    return spark.createDataFrame(ENTRIES, "token string, original string")


def test_tokens_are_whole_words_and_unknown_ones_marked(spark, texts):
    out = un.unmask(texts("gv_001+gv_1000*gv_0010 xgv_001 gv_999 gv_12 gv_001", ""), _entries(spark))
    rows = out.orderBy("doc_id").collect()
    assert rows[0].text == "rate+late*odd xgv_001 NEW_gv_999 gv_12 rate"
    assert rows[0].n_restored == 3 and rows[0].unknown == ["gv_999"]
    assert rows[1].text == "" and rows[1].unknown == []


def test_one_dictionary_per_map(spark):
    docs = spark.createDataFrame([(1, "m1", "gv_001"), (2, "m2", "gv_001")], "doc_id long, map_id string, text string")
    entries = spark.createDataFrame([("m1", "gv_001", "a"), ("m2", "gv_001", "b")], "map_id string, token string, original string")
    assert column(un.unmask(docs, entries, map_col="map_id")) == ["a", "b"]


REPLY = "See `gv_001`: gv_001's and gv_001-like, gv_001/gf_001 (gv_001) gv_001_x gv_001\n```py\nimport os\ngv_001 = gf_777()\n```\nmid ```\nplain gf_001\n``` end gv_001"


def test_zones(texts):
    rows = un.zones(texts(REPLY, "no zones", ""), ["doc_id"]).orderBy("doc_id", "zone").collect()
    first = [(r.zone_type, r.language, r.content) for r in rows if r.doc_id == 1]
    assert [z[:2] for z in first] == [
        ("prose", ""),
        ("inline_code", ""),
        ("prose", ""),
        ("code_block", "py"),
        ("prose", ""),
        ("code_block", ""),
        ("prose", ""),
    ]
    assert first[3][2] == "import os\ngv_001 = gf_777()\n"
    assert [r.zone_type for r in rows if r.doc_id == 2] == ["prose"]
    assert not [r for r in rows if r.doc_id == 3]


def test_replies_are_restored_zone_by_zone(spark, texts):
    row = un.unmask_replies(texts(REPLY, "plain"), _entries(spark), ["doc_id"]).orderBy("doc_id").collect()
    assert row[0].explanation == (
        "See `rate`: rate's and rate-like, rate/price_of (rate) gv_001_x rate\n```py\nimport os\nrate = NEW_gf_777()\n\n```"
        "\nmid ```\nplain price_of\n\n``` end rate"
    )
    assert row[0].code == "import os\nrate = NEW_gf_777()\n\n\nplain price_of\n"
    assert row[0].new_symbols == ["gf_777"] and row[0].new_dependencies == ["import os"] and row[0].n_restored == 2
    assert row[1].explanation == "plain" and row[1].code == ""


def test_unknown_tokens(spark, texts):
    rows = un.unknown_tokens(texts("gv_001 gv_404 gv_404"), _entries(spark)).collect()
    assert [(r.token, r.n) for r in rows] == [("gv_404", 2)]


def test_thousands_of_zones(spark):
    """Each zone restores its own tokens, in time linear in the reply."""
    entries = spark.createDataFrame([(f"gv_{i:03d}", f"name{i}") for i in range(1, 3000)], "token string, original string")
    text = "".join(f"see `gv_{i:03d}` and\n```py\ngv_{i:03d} = gf_{i:03d}\n```\n" for i in range(1, 3000))
    docs = spark.createDataFrame([(1, text), (2, "no zone at all"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in un.unmask_replies(docs, entries, ["doc_id"]).collect()}
    assert got[1].explanation == "".join(f"see `name{i}` and\n```py\nname{i} = NEW_gf_{i:03d}\n\n```\n" for i in range(1, 3000))
    assert got[1].n_restored == 2999 and len(got[1].new_symbols) == 2999
    assert got[2].explanation == "no zone at all" and got[3].explanation == ""
