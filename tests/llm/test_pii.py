"""PII spans against a plain version with Python's patterns."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import pii
from cloakframe.llm.queries import op2_pii

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    text = text or ""
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def found(df):
    return {
        r["doc_id"]: {k: [(s["start"], s["end"]) for s in r[k]] for k in pii.BASE}
        for r in pii.pii_spans(df).collect()
    }


HARD = [
    None, "", "a@b.c d@e.f", "a@b.c_d@e.f g@h", "x.y+z%@a-b.c-d.e.", "@a.b", "é@a.bc ü x@y.zé",
    "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 001.02.3.4 0.0.0.0 1.2.3", "99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 x 4111  1111 1111 1111", "5 5 5 5 5 5 5 5 5 5 5 5 5 5",
    "41111111111111111", "+1 (487) 555-7209 ndhain", "+1234567 +123456789+1234567890", "++49 30 1234567-", "+1)))2 +1.2",
    "😀 mail x@y.zz 😀 1.2.3.4", "378282246310005 4012888888881881,6011111111111117",
]


def test_hard_texts(texts):
    got = found(texts(*HARD))
    for i, text in enumerate(HARD, 1):
        assert got[i] == plain(text), text


def test_random_texts(texts):
    draw = random.Random(3)
    rows = ["".join(draw.choice("0123456789. -+()@abZ%_é") for _ in range(draw.randint(0, 120))) for _ in range(400)]
    got = found(texts(*rows))
    for i, text in enumerate(rows, 1):
        assert got[i] == plain(text), text


def test_long_runs_are_linear(texts):
    rows = ["a" * 300_000, "1" * 300_000, "1 " * 100_000, "1." * 100_000, "+1" + "-" * 200_000, "a@" + "b." * 50_000]
    started = time.time()
    got = found(texts(*rows))
    assert time.time() - started < 60
    assert got[6]["email"] == [(0, 2 + 99_999)]


def test_iban_and_context(texts):
    df = texts("IBAN DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01", "account 12345678 and 12345678", "12345678 account")
    rows = [r for r in pii.pii_spans(df).orderBy("doc_id").collect()]
    assert [(s["start"], s["end"]) for s in rows[0]["iban"]] == [(5, 32)]
    assert rows[1]["iban"] == []
    assert [(s["start"], s["end"]) for s in rows[2]["id"]] == [(8, 16)]
    assert rows[3]["id"] == []


def test_masking(spark):
    rows = [(1, "x a@b.c, 1.2.3.4 😀 z", "s", 20, 1), (2, None, None, None, 2), (3, "é clean", "s", 7, 3), (4, "+1 4111 1111 1111 1111", "s", 9, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _score int")
    got = {r["doc_id"]: r for r in pii.mask_pii(df).collect()}
    assert pii.mask_pii(df).columns == df.columns
    assert got[1]["text"] == "x <EMAIL>, <IP> 😀 z" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[2]["n_chars"] is None
    assert got[3]["text"] == "é clean" and got[3]["n_chars"] == 7
    # The card starts behind the sign and the country code: one chain of digits with the 1 before it.
    assert got[4]["text"] == plain_mask("+1 4111 1111 1111 1111")


def plain_mask(text):
    spans = sorted((s, e, k) for k, at in plain(text).items() for s, e in at)
    out, last = "", 0
    merged = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2])
        else:
            merged.append((s, e, k))
    for s, e, k in merged:
        out += text[last:s] + f"<{k.upper()}>"
        last = e
    return out + text[last:]


def test_masking_random(texts):
    draw = random.Random(5)
    rows = [" ".join(draw.choice(["a@b.cd", "1.2.3.4", "+49 30 123456789", "4111111111111111", "w", "é"]) for _ in range(60)) for _ in range(50)]
    got = {r["doc_id"]: r["text"] for r in pii.mask_pii(texts(*rows)).collect()}
    for i, text in enumerate(rows, 1):
        assert got[i] == plain_mask(text)


def test_query(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op2_pii(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(rows[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for k in PLAIN for s, e in want[k])
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [len(want[k]) for k in PLAIN]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string")
    assert pii.pii_spans(df).collect() == [] and pii.mask_pii(df).collect() == []
