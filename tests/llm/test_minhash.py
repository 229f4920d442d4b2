"""MinHash: edits and likeness against plain versions, classes against all pairs."""

import hashlib
import random

from cloakframe.llm import minhash
from cloakframe.llm.queries import op4_minhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got, mean=0.03):
    """rows in descending order of doc_id; got by doc_id. One estimate has a deviation of up to 0.044."""
    errors = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r["near_edited"] - jaccard(text, edited)), abs(r["near_next"] - jaccard(text, after))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < mean


def test_query(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in op4_minhash(spark, SF).collect()}
    assert len(got) == len(rows)
    check(sorted(rows, reverse=True), got)
    prints = {}
    for doc, text in rows:
        assert prints.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]


def test_few_rows(spark):
    for n in (1, 2, 5):
        rows = [(i * 10, f"text number {i} 😀 with some more words é" * (i + 1)) for i in range(n)]
        got = minhash.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == n
        check(sorted(rows, reverse=True), {r["doc_id"]: r for r in got}, mean=0.06)


def test_odd_and_empty(odd_documents, no_documents):
    got = minhash.fingerprint_edits(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert minhash.fingerprint_edits(no_documents).collect() == []
    assert minhash.near_duplicate_classes(no_documents).collect() == []


def test_classes(spark):
    draw = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{draw.randrange(5000)}" for _ in range(120)]
        for _ in range(draw.randint(1, 5)):
            w = list(base)
            for _ in range(draw.randint(0, 2)):
                w[draw.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "  ")]
    root = {d: d for d, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if jaccard(s, t) >= 0.8 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d, _ in rows}


def test_drifted_copies(spark, monkeypatch):
    """Large groups of near copies, and one text near a single copy far from the others."""
    rows = []
    for seed in (9, 35, 40):  # groups whose link to the drifted text was lost in every bucket
        draw = random.Random(seed)
        base = [f"s{seed}w{i}" for i in range(200)]
        copies = []
        for k in range(250):
            w = list(base)
            w[draw.randrange(10, 190)] = f"c{k}"
            copies.append(w)
        drifted = list(copies[-1])
        at = drifted.index("c249")
        for i in range(4):
            drifted[(at + 20 + 20 * i - 10) % 180 + 10] = f"y{i}"
        rows += copies + [drifted]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= 0.8 * (len(a) + len(sets[j]) - common) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 7):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(df).collect()} == want


def test_many_texts_of_one_template(spark, monkeypatch):
    """Texts of one template, pairwise near 0.6, some with a near copy: no text is lost, and blocks of any size agree."""
    draw = random.Random(6)
    base = [f"t{i}" for i in range(160)]
    rows = []
    for k in range(400):
        w = list(base)
        for place in draw.sample(range(0, 150, 6), 7):
            w[place] = f"k{k}p{place}"
        rows.append((len(rows), " ".join(w)))
        if k % 10 == 0:
            w[155] = "copy"
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= 0.8 * (len(a) + len(sets[j]) - common) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i, _ in rows}
    assert len(set(want.values())) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 50):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(df).collect()}
        assert got == want
