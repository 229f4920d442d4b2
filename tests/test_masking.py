import pytest
from pyspark.sql import functions as F

from cloakframe.operators import dictionary as dic
from cloakframe.operators import extract, masking
from cloakframe.operators.unmask import restore_comments, unmask
from cloakframe.plans.mask import mask, restore

from .conftest import column
from .test_extract import CPP, PYTHON


def _apply(texts, expression, *rows):
    return column(texts(*rows).withColumn("text", expression))


def test_rename_leaves_substrings_strings_and_comments(texts):
    docs = texts('count = 1\ncounter = count + 1  # count\nprint("count", count)\n')
    found = extract.symbols(docs, "python")
    out = masking.rename(docs, found, dic.build_dictionary(found), "python", count_as="n").head()
    assert out.text == 'gv_001 = 1\ngv_002 = gv_001 + 1  # count\nprint("count", gv_001)\n'
    assert out.n == 2


def test_published_example(texts):
    code = (
        "def calculate_revenue(transactions):\n    total_income = 0\n    for txn in transactions:\n"
        "        total_income += txn\n    return total_income\n"
    )
    docs = texts(code)
    found = extract.symbols(docs, "python")
    out = masking.rename(docs, found, dic.build_dictionary(found), "python").head().text
    assert out == (
        "def gf_001(gv_001):\n    gv_002 = 0\n    for gv_003 in gv_001:\n        gv_002 += gv_003\n    return gv_002\n"
    )


def test_strip_comments(texts):
    python = 'a = 1  # one\n  # whole line\nb = "# kept"\ndef f():\n    """Doc\n    more."""\n\n    return b # end'
    cpp = 'int a; // one\n// whole\n/* x */ /* y */\nint /* in */ b; char *s = "// kept";'
    html = "<p>a<!-- x -->b</p>\n <!-- y -->\n<i>c</i>"
    assert _apply(texts, masking.strip_comments(F.col("text"), "python"), python) == [
        'a = 1\nb = "# kept"\ndef f():\n    return b'
    ]
    assert _apply(texts, masking.strip_comments(F.col("text"), "cpp"), cpp) == ['int a;\nint b; char *s = "// kept";']
    assert _apply(texts, masking.strip_comments(F.col("text"), "html"), html) == ["<p>ab</p>\n<i>c</i>"]


def test_placeholders_keep_the_syntax_and_restore(texts):
    for language, code in (("python", PYTHON), ("cpp", CPP), ("html", "<!-- a -->x<!--b-->")):
        docs = texts(code)
        store = masking.comment_store(docs, language)
        hidden = docs.withColumn("text", masking.placeholder_comments(F.col("text"), language))
        text = hidden.head().text
        for r in store.collect():
            assert r.token in text and (len(r.original) < 9 or r.original not in text)
        assert restore_comments(hidden, store).head().text == code
    assert _apply(texts, masking.placeholder_comments(F.col("text"), "python"), "# a\nx = 1 # b\n") == [
        "# [gk_002]\nx = 1 # [gk_001]\n"
    ]


def test_loop_bounds(texts):
    docs = texts("for (int i = 0; i < 64; i++) for(;j>=1 ;) k\nfor x in range(10): range(1, 20) range(1) range( 7)")
    found = masking.bounds(docs)
    entries = dic.build_dictionary(found.select("doc_id", "name", "kind", "scope").distinct())
    out = masking.generalize_bounds(docs, found, entries).head().text
    assert out == "for (int i = 0; i < gc_002; i++) for(;j>=1 ;) k\nfor x in range(gc_001): range(1, 20) range(1) range( 7)"


def test_format_specifiers(texts):
    assert _apply(texts, masking.keep_format(F.col("text")), '"Sensor %d reported %.2f at %%\\n"', '"none"') == [
        '"%d %.2f %% \\n"',
        '""',
    ]


def test_span(texts):
    assert _apply(texts, masking.mask_span(F.col("text"), F.lit(3), F.lit(2), F.upper), "abcdef", "a", "") == ["abCDef", "a", ""]


@pytest.mark.parametrize("language,code", [("python", PYTHON), ("cpp", CPP)])
@pytest.mark.parametrize("keep", [False, True])
def test_levels_hide_names_and_come_back(texts, language, code, keep):
    docs = texts(code, code.replace("order", "parcel"))
    for level in (1, 2, 4):
        out = mask(docs, level, language, keep_comments=keep)
        masked = column(out.docs)
        originals = {r.original for r in out.symbols.select(F.col("name").alias("original")).collect()}
        words = {w.name for w in extract.occurrences(out.docs, language).collect()}
        assert not originals & words
        back = column(restore(out))
        if keep:
            assert back == [code, code.replace("order", "parcel")]
        else:
            assert back == column(docs.withColumn("text", masking.strip_comments(F.col("text"), language)))
        assert masked != back


def test_same_name_same_token_over_documents_and_a_given_dictionary(texts):
    first = mask(texts("alpha beta"), 1)
    second = mask(texts("beta gamma"), 1, dictionary=first.dictionary)
    assert column(second.docs) == ["gv_002 gv_003"]
    assert column(unmask(second.docs, second.dictionary)) == ["beta gamma"]


def test_isolation_and_its_fallback(texts):
    docs = texts(PYTHON, "x = 1\n").withColumn("section", F.lit("main_flow"))
    out = mask(docs, 3, "python", section_col="section")
    rows = out.docs.orderBy("doc_id").collect()
    assert [r.isolated for r in rows] == [True, False]
    assert "amount" not in rows[0].text and "return" not in rows[0].text
    assert [(r.doc_id, r.symbol) for r in out.warnings.collect()] == [(2, "main_flow")]
