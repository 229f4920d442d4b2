"""The Merkle manifest against a tree built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import merkle
from cloakframe.llm.queries import ORACLES, op12_merkle
from cloakframe.operators import lookups
from tools.check_oracles import connect, rows_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, at):
    """Per level: digests to the left and to the right."""
    for level in tree[:-1]:
        run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(level)))
        yield [level[i] for i in run if i < at], [level[i] for i in run if i > at]
        at //= 3


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row["source"], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[name] = levels([leaf_of(r) for r in by[name]])
    crown = levels([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for at, row in enumerate(by[name]):
            steps = [*way(trees[name], at), *way(crown, place)]
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of({**row, "text": text})
            for left, right in steps:
                folded = h(*left, folded, *right)
            proof = h(*[d for left, right in steps for d in left + right])
            out.append((row["doc_id"], leaf_of(row), trees[name][-1][0], crown[-1][0], proof, folded, folded == crown[-1][0]))
    return sorted(out, key=repr)


def run(spark, df, **how):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.manifest(df, **how, claimed=merkle.leaf_hash(text=tampered)).withColumn("check", merkle.folded("claimed", "witness"))
    got = made.select("doc_id", "leaf", "subroot", "root", "check.proof_sha256", "check.root").collect()
    return sorted(((*r, r[5] == r[3]) for r in got), key=repr)


def rows_made(sizes):
    draw = random.Random(3)
    rows, next_id = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            next_id += draw.randint(1, 3)
            text = draw.choice([None, "", "a\nb", f"text {next_id}\n\nof é 😀", "plain"])
            rows.append({"doc_id": next_id, "text": text, "lang": draw.choice(["en", None]), "source": source, "n_chars": draw.choice([None, 7])})
    draw.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_appender_equals_levels(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    tree = merkle.Appender()
    for leaf in leaves:
        tree.append(leaf)
    top, want = tree.close(None), levels([x.hex() for x in leaves])
    assert top.hex() == want[-1][0]
    for at, leaf in enumerate(leaves):
        folded, proof = merkle.fold(leaf, bytes(tree.witness[at]))
        assert folded == top
        assert proof.hex() == h(*[d for left, right in way(want, at) for d in left + right])


def test_sources_of_all_sizes(spark):
    rows = rows_made({None: 5, "": 1, "a": 3, "B": 4, "é": 9, "z" * 50: 28, "hot": 2200})
    assert run(spark, frame(spark, rows)) == plain(rows)


def test_many_rounds_and_sources(spark, monkeypatch):
    # Blocks of nine leaves: a source of 800 takes four rounds, the 44 sources two.
    monkeypatch.setattr(lookups, "HOT_FLOOR", 3)
    rows = rows_made({**{f"s{i}": i % 12 + 1 for i in range(40)}, "hot": 800, "nine": 9, "ten": 10, "eightyone": 81})
    assert run(spark, frame(spark, rows), height=2) == plain(rows)


def test_one_row_and_one_source(spark):
    for rows in (rows_made({"only": 1}), rows_made({None: 7})):
        assert run(spark, frame(spark, rows)) == plain(rows)


def test_query_equals_sql(spark):
    df = op12_merkle(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = connect(SF).execute(ORACLES["op12_merkle"])
    assert got == rows_of([d[0] for d in relation.description], relation.fetchall())


def test_odd_and_empty(spark, odd_documents, no_documents):
    rows = [r.asDict() for r in odd_documents.collect()]
    clash = odd_documents.withColumns({c: F.lit(1) for c in ("group", "at", "total", "block", "leaf", "witness", "_tie", "_row", "digest")})
    assert run(spark, clash) == plain(rows)
    assert merkle.manifest(no_documents).collect() == []
