"""The pipeline: each stage on what the one before kept."""

import corpus_pipeline
from corpus_pipeline import STAGES
from cloakframe.llm import decontaminate, pii
from cloakframe.llm.common import table
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    benchmark = table(spark, SF, "benchmark")
    seen = {}
    for name, stage in STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF).persist()
        after = docs.collect()
        seen[name] = (before, after)
        if name != STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["quality"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    good = [d for d, q in labels.items() if q == 1 and d in {r["doc_id"] for r in before}]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)
    before, after = seen["near_duplicates"]
    parts = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(parts.values()))
    before, after = seen["decontamination"]
    hit = {r["doc_id"] for r in decontaminate.contamination(spark.createDataFrame(before), benchmark).where("n_hit > 0").collect()}
    assert hit and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - hit
    before, after = seen["personal_data"]
    spans = pii.pii_spans(spark.createDataFrame(before)).collect()
    some = {r["doc_id"] for r in spans if any(r[k] for k in pii.KINDS)}
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        assert (r["text"] != texts[r["doc_id"]]) == (r["doc_id"] in some)
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert 0.7 < len(after) / len(before) < 1.4


def test_run_is_repeatable(spark):
    names = ["doc_id", "copy_no", "shuffle_key"]
    a = {tuple(r[n] for n in names) for r in corpus_pipeline.run(spark, SF).collect()}
    b = {tuple(r[n] for n in names) for r in corpus_pipeline.run(spark, SF).collect()}
    assert a == b and a


def test_odd_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        STAGES[-1][1](spark, docs, SF).collect()
