"""Quality and toxicity: the arithmetic against plain versions, held-out accuracy, odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import quality, toxicity
from cloakframe.llm.common import bounded_sample, fold, labelled_keys, rows_of_keys
from cloakframe.llm.queries import op1_quality, op3_toxicity

SF = "/root/testdata/sf0.01"


def area(scores, labels):
    """Share of pairs (label 1, label 0) in the right order."""
    order = np.argsort(np.argsort(scores)) + 1
    n1 = labels.sum()
    return (order[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


def test_machine_sums_all_pairs():
    draw = np.random.default_rng(0)
    model = quality.Machine(draw.normal(size=50), draw.normal(size=(50, 4)), 0.3)
    rows = [(np.sort(draw.choice(50, n, replace=False)), draw.normal(size=n)) for n in (1, 2, 7, 20)]
    starts = np.cumsum([0, *(len(i) for i, _ in rows)])[:-1]
    got = model.margins(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
    for (index, x), margin in zip(rows, got):
        want = 0.3 + sum(model.w[i] * v for i, v in zip(index, x))
        for a in range(len(index)):
            for b in range(a):
                want += model.v[index[a]] @ model.v[index[b]] * x[a] * x[b]
        assert margin == pytest.approx(want)


def test_machine_learns_a_pair():
    """Label 1 only if exactly one of two features is there: no linear model can."""
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(800):
        a, b = draw.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b]), np.ones(2)))
        labels.append(float(a != b))
    labels = np.array(labels)
    model = quality.fit(rows, labels, 4)
    starts = np.arange(0, 1600, 2)
    margins = model.margins(np.concatenate([i for i, _ in rows]), np.ones(1600), starts)
    assert ((margins > 0) == (labels == 1)).all()


def test_quality_on_held_out_rows(spark):
    got = op1_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert area(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.95
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    again = op1_quality(spark, SF).toPandas().sort_values("doc_id")
    assert np.allclose(again["score"], got.sort_values("doc_id")["score"])


def test_toxicity_on_held_out_rows(spark):
    got = op3_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert area(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.85
    assert (held.loc[held["toxic"] == 0, "predicted"] == 0).mean() > 0.95


def test_folds(spark):
    import zlib

    df = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("f", fold(5))
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in df.collect())


def weight(text, **more):
    return toxicity.matches(text, toxicity.Lexicon(more.get("words", {}), more.get("beginnings", {})))[0]


def test_grammar():
    plain, aimed = weight("such an idiot."), weight("you idiot.")
    assert aimed > plain > 0
    assert 0 < weight("he is not an idiot") < weight("he is an idiot")
    assert 0 < weight("somebody said idiot") < plain
    assert weight("the plan may kill time") == 0 < weight("i will kill you")
    assert weight("do not kill you") == 0 or weight("do not kill you") < weight("i will kill you")
    assert weight("you. idiot") == plain  # a target counts inside its clause only
    assert weight("nothing here") == weight("") == 0
    assert weight("loweischaft", beginnings={"lowei": 2.0}) == 2.0 and weight("lowe", beginnings={"lowei": 2.0}) == 0


def test_composition_is_running_one_after_the_other():
    draw = np.random.default_rng(3)
    both = toxicity.NEGATION.then(toxicity.REPORTED)
    for _ in range(200):
        a = b = c = 0
        for symbol in draw.integers(0, 6, 12).tolist():
            a, middle, x = toxicity.NEGATION.rule(a, symbol)
            b, out, y = toxicity.REPORTED.rule(b, middle)
            c, written, z = both.rule(c, symbol)
            assert written == out and z == pytest.approx(x * y)


def plain_clause_weight(symbols):
    """The five transducers one after the other, each as a pass over what the one before has written."""
    factors = [1.0] * len(symbols)
    written = [s for s, _ in symbols]
    for machine in (toxicity.INSULTING, toxicity.NEGATION, toxicity.REPORTED, toxicity.TARGET, toxicity.THREAT):
        state = 0
        for i, symbol in enumerate(written):
            state, written[i], factor = machine.rule(state, symbol)
            factors[i] *= factor
    total = 0.0
    for out, factor, (_, weight) in zip(written, factors, symbols):
        if out in (toxicity.INSULT, toxicity.WEAK_INSULT, toxicity.HARD_INSULT):
            total += weight * factor
        elif out == toxicity.HARD_THREAT:
            total += toxicity.THREAT_WEIGHT * factor
    return total


def test_clauses_equal_a_plain_run():
    draw = np.random.default_rng(4)
    for _ in range(500):
        kinds = draw.integers(0, 6, draw.integers(1, 25)).tolist()
        symbols = [(k, float(draw.uniform(0.5, 4)) if k == toxicity.INSULT else 0.0) for k in kinds]
        assert toxicity.clause_weight(symbols) == pytest.approx(plain_clause_weight(symbols))
    assert weight("idiot and moron") > weight("idiot") + weight("moron") - 1e-9


def test_matches_equal_a_plain_run():
    """Clauses, matches and their sums of whole texts."""
    draw = np.random.default_rng(5)
    words = ["you", "idiot", "not", "said", "kill", "moron", "tree", "a", ".", "!", ";", "they", "scum", "never", "loweischaft"]
    lexicon = toxicity.Lexicon({"tree": 0.5}, {"lowei": 2.0})
    for _ in range(200):
        text = " ".join(draw.choice(words, draw.integers(0, 60)))
        clauses = [c.split() for c in re.split(r"[.!?;:\n]", text)]
        found = [plain_clause_weight([lexicon.of(w) or (toxicity.OTHER, 0.0) for w in c]) for c in clauses]
        hit = [x for x in found if x > 0]
        want = [max(hit, default=0.0), np.log1p(sum(hit)), np.log1p(len(hit)), len(hit) / len(clauses)]
        assert toxicity.matches(text, lexicon) == pytest.approx(want)


def test_odd_and_empty(spark, odd_documents, no_documents, odd_labels):
    none = odd_labels.limit(0)
    for docs in (odd_documents, no_documents):
        for labels in (odd_labels, none, odd_labels.where("quality = 1")):
            model = quality.train(docs, labels, "quality", ["n_chars", "lang"])
            scored = quality.with_score(docs, model, ["n_chars", "lang"], "new").collect()
            assert len(scored) == docs.count() and all(0 <= r["new"] <= 1 for r in scored)
            grammar = toxicity.train(docs, labels, "toxic")
            scored = toxicity.with_score(docs, grammar, "new").collect()
            assert len(scored) == docs.count() and all(0 <= r["new"] <= 1 for r in scored)


def test_samples_bound_rows_of_a_repeated_id(spark, monkeypatch):
    """One labelled id on 60,000 rows, half of them equal: at most about the bound leaves the executors."""
    docs = spark.range(60_000).selectExpr("if(id < 59000, 7, id) doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id, ' you idiot')) text")
    labels = spark.createDataFrame([(7, 1, 1), (59_001, 0, 0), (59_003, 0, 0)], "doc_id long, quality int, toxic int")
    keys = labelled_keys(docs, labels, "quality")
    assert keys.count() == 29_500 + 1 + 2
    for bound in (500, 4000):
        chosen = bounded_sample(keys, bound)
        assert 0.8 * bound < chosen.count() < 1.1 * bound
        rows = rows_of_keys(docs, chosen, text=F.col("text")).distinct()
        assert rows.count() == chosen.count()
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels, size: fitted.append(len(rows)) or quality.Machine(constant=0.5))
    quality.train(docs, labels, "quality", [], sample=500)
    assert 400 < fitted[0] < 550
