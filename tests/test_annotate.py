from cloakframe.operators import annotate

TEXT = (
    "Please rename `rate`. The Rate is a confusing name! Consider calling rate differently\n"
    "A better name for rate. rate could be called x. variable name rate, rename rated"
)


def _entries(spark):
    rows = [("gv_001", 1, "rate"), ("gf_001", 1, "stubbed")]
    return spark.createDataFrame(rows, "token string, seq long, original string")


def test_six_phrases_about_names(spark, texts):
    rows = annotate.naming_advice(texts(TEXT, "nothing"), _entries(spark), ["doc_id"]).orderBy("template").collect()
    assert [(r.doc_id, r.original, r.template) for r in rows] == [(1, "rate", n) for n in range(1, 7)]
    assert rows[0].sentence == "Please rename `rate`" and "gv_001" in rows[0].note
    assert rows[1].sentence == "The Rate is a confusing name"


def test_guesses_about_stubs(spark, texts):
    stubs = spark.createDataFrame([("stubbed",)], "original string")
    long = "and then stubbed does one two three four five six seven eight things here"
    rows = annotate.stub_speculation(
        texts(
            "stubbed probably return x. I'm not sure. Assuming so. Inside stubbed. Verify that stubbed works",
            f"Short stubbed. {long}. More.",
            "brief stubbed mention",
            "might be wrong",
        ),
        stubs,
        ["doc_id"],
    ).collect()
    assert {(r.doc_id, r.template) for r in rows} == {(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0)}
    assert [r.sentence for r in rows if r.doc_id == 2] == [long]


def test_sentences_are_cut(texts):
    rows = annotate.sentences(texts("A. b!\n\n " + "x" * 200), ["doc_id"]).orderBy("nth").collect()
    assert [r.sentence for r in rows] == ["A", "b", "x" * 150 + "..."]


def test_footnotes(spark, texts):
    docs = texts("Please rename rate.", "plain")
    out = annotate.footnotes(docs, annotate.naming_advice(docs, _entries(spark), ["doc_id"]), ["doc_id"]).orderBy("doc_id").collect()
    assert out[0].annotations == 1 and "[~~ 1]" in out[0].text and 'Context: "Please rename rate..."' in out[0].text
    assert (out[1].text, out[1].annotations) == ("plain", 0)
