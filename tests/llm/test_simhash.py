"""SimHash against all pairs compared one by one."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cloakframe.llm import simhash
from cloakframe.llm.components import connected_components
from cloakframe.llm.queries import op7_simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids_and_prints, radius=3):
    prints = sorted({p for _, p in ids_and_prints})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, p in ids_and_prints:
        least[find(p)] = min(d, least.get(find(p), d))
    return {d: least[find(p)] for d, p in ids_and_prints}


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    want = plain_components(prints)
    got = op7_simhash(spark, SF).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)


def near_copies(draw, groups, members, flips):
    out = []
    for _ in range(groups):
        base = draw.getrandbits(64)
        for _ in range(members):
            x = base
            for _ in range(draw.randint(0, flips)):
                x ^= 1 << draw.randrange(64)
            out.append(x)
    return sorted(set(out))


def test_links_connect_what_is_near(spark):
    draw = random.Random(1)
    prints = near_copies(draw, 60, 12, 4) + [draw.getrandbits(64) for _ in range(300)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp long")
    for block in (2048, 5):  # small blocks: every key with more members is cut into pairs of blocks
        parts = connected_components(simhash.near_links(df, 3, block)).collect()
        got = {int(np.array(r["node"], np.int64).view(np.uint64)): r["root"] for r in parts}
        want = plain_components(list(zip(prints, prints)))
        classes = {}
        for p in prints:
            classes.setdefault(want[p], []).append(p)
        for members in classes.values():
            assert len({got.get(p, ("alone", p)) for p in members}) == 1
        assert len({got[p] for p in prints if p in got}) == sum(len(m) > 1 for m in classes.values())


def test_bit_planes_count_distances():
    draw = random.Random(2)
    for m in (1, 2, 63, 64, 65, 200):
        prints = np.array([draw.getrandbits(64) & 0xFFFF0000FFFF if i % 3 else draw.getrandbits(4) for i in range(m)], np.uint64)
        for radius in (0, 3, 7):
            near = np.unpackbits(simhash.within(prints, radius).view(np.uint8), axis=1, bitorder="little")[:, :m]
            want = [[bin(int(a) ^ int(b)).count("1") <= radius for b in prints] for a in prints]
            assert (near == np.array(want)).all()


def test_odd_documents(odd_documents, no_documents):
    got = simhash.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert by[(2, 0)] == by[(3, 0)] == by[(4, 0)] == by[(None, 0)] == 2
    assert simhash.near_duplicates(no_documents).collect() == []


def test_keep_one(odd_documents, no_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = kept.collect()
    # One for the empty texts, one of the repeated rows, and each text that stands alone.
    assert sorted(r["doc_id"] or -1 for r in rows) == [-1, 1, 1, 2, 5, 6]
    assert simhash.keep_one(no_documents).collect() == []


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1)], "a long, b long").where(F.lit(True))).count() == 0
