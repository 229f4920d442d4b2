"""The language model against counting by hand, and its automaton against looking up longest suffixes."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import suffix_tree as st
from cloakframe.llm.queries import op9_suffix_tree

SF = "/root/testdata/sf0.001"


def tokens(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("top", [1 << 20, 50])
def test_base_model(spark, top, monkeypatch):
    """Once with all words given to the scan, once with nearly all of them joined."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    trained = [t for d, t in held.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for t in trained for w in [*tokens(t), "end"])
    n, v = sum(counts.values()), len(counts)
    from cloakframe.llm.common import fold

    model, rare = st.fit(docs.where(fold(7) != 2), top_words=top)
    got = st.score_texts(docs, model, rare, [F.col("doc_id"), (fold(7) == 2).alias("held_out")]).collect()
    assert len(got) == len(held)
    for r in got:
        own = [*tokens(held[r["doc_id"]]), "end"]
        assert r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["score"] < 0


def plain_tree(texts, least):
    """Counts of every context by hand, and the contexts that pass the test."""
    table: dict[bytes, Counter] = {}
    total = 0
    for text in texts:
        line = st.END * st.DEPTH + b" ".join(tokens(text)) + st.END
        for i in range(st.DEPTH, len(line)):
            total += 1
            for d in range(st.DEPTH + 1):
                table.setdefault(line[i - d : i], Counter())[line[i]] += 1
    kept = {b""}
    for c, after in table.items():
        if c:
            n, up = sum(after.values()), table[c[1:]]
            n_up = sum(up.values())
            gain = sum(k * math.log2(k / n / (up[s] / n_up)) for s, k in after.items())
            if gain >= least * total - 1e-9 and gain >= st.COST * len(after) * math.log2(n + 1) - 1e-9:
                kept |= {c[i:] for i in range(len(c))}
    return table, kept


def plain_score(text, table, kept):
    def share(context, symbol):
        after = table.get(context, Counter())
        n = sum(after.values())
        if not context:
            return (after[symbol] + 1) / (n + 256)
        return (after[symbol] + len(after) * share(context[1:], symbol)) / (n + len(after))

    line = st.END * st.DEPTH + b" ".join(tokens(text)) + st.END
    out = 0.0
    for i in range(st.DEPTH, len(line)):
        context = next(line[i - d : i] for d in range(st.DEPTH, -1, -1) if line[i - d : i] in kept)
        out += math.log10(share(context, line[i]))
    return out


def test_tree_and_scores(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "THE  mat\n", "", None, "über das Öl " * 90]
    others = ["the cat", "zebra Ω", None, "on the the the", "ö" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = 2e-3
    model, rare = st.fit(df, least_gain=least)
    table, kept = plain_tree(texts, least)
    asked = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in st.score_texts(asked, model, rare, [F.col("doc_id")]).collect()}
    for i, text in enumerate(texts + others):
        assert got[i] == pytest.approx(plain_score(text, table, kept), rel=1e-4), text


def test_each_state_is_a_distribution(spark):
    df = spark.createDataFrame([(1, "abra cadabra abra"), (2, "cad bra")], "doc_id long, text string")
    model, _ = st.fit(df, least_gain=1e-3)
    p = 10.0 ** model.automaton.gain.astype(float)
    unseen = 256 - (p.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(axis=1) + unseen * p[:, -1], 1, atol=1e-4)


def test_query(spark):
    got = op9_suffix_tree(spark, SF).toPandas()
    assert len(got) == 200 and got["n_known"].le(got["n_tokens"]).all()
    assert got["score"].sum() > got["base_score"].sum()


def test_odd_and_empty(odd_documents, no_documents):
    for train in (odd_documents, no_documents):
        for docs in (odd_documents, no_documents):
            model, rare = st.fit(train)
            got = st.score_texts(docs, model, rare, [F.col("doc_id")]).collect()
            assert len(got) == docs.count()
            if train is no_documents:
                assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in got)
