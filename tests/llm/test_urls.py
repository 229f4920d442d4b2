"""URL parts and given rules against a plain version; mined rules against all subsets."""

import re
from itertools import combinations, product

from cloakframe.llm import urls
from cloakframe.llm.queries import URL_RULES, op5_urls

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    best = None
    for h, p, verdict in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


HARD = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x", "https://a.b.net?x=1/y", "x://net", "http://net/", "http://example.com#/de/",
    "http://example.com/de", "http://example.com/de/?q", "http://example.com/DE/", "http://wexample.com/de/a", "http://m.example.org/fr/1://2",
    "a://b://c.net/x", "http://u:p@example.net:80/en/", "http://example.net:80/", "http://é.org/fr/ü", "http://org/fr/", "http://borg/fr/",
]


def test_hard_urls(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df, URL_RULES).collect()}
    assert len(got) == len(HARD)
    for i, url in enumerate(HARD):
        host, path, best = plain(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0]), url
        if best:
            assert got[i]["verdict"] == best[1]


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: r for r in op5_urls(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        host, path, best = plain(r["url"])
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, best and best[0])
        assert g["verdict"] == best[1] if best else g["verdict"] in ("allow", "block")


def mined_plain(rows, support, confidence):
    n, found = len(rows), {}
    for size in range(1, 5):
        for part in {c for t, _ in rows for c in combinations(sorted(t), size)}:
            held = [v for t, v in rows if set(part) <= set(t)]
            for verdict in ("block", "allow"):
                k = held.count(verdict)
                if k / n >= support and k / len(held) >= confidence:
                    found[part, verdict] = k / len(held)
    return {
        (p, v): c
        for (p, v), c in found.items()
        if not any(w == v and set(q) < set(p) and d >= c for (q, w), d in found.items())
    }


def test_mined_rules(spark):
    rows = []
    for i in range(200):
        tokens = [f"host={i % 5}", f"path={i % 7}", f"x={i % 2}"] + (["spam"] if i % 3 == 0 else [])
        rows.append((tokens, "block" if i % 3 == 0 and i % 7 != 2 or i % 35 == 4 else "allow"))
    # Tokens on the same rows: some of one kind only, some that a rule of two tokens holds.
    rows = [(t + ["twin=1"] * ("x=1" in t) + ["copy", "more"] * ("spam" in t), v) for t, v in rows]
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.8).collect()
    assert {(tuple(sorted(ts)), r["verdict"]): round(r["confidence"], 9) for r in got for ts in product(*r["alike"])} == {
        k: round(c, 9) for k, c in mined_plain(rows, 0.1, 0.8).items()
    }


def test_forty_tokens_that_come_together(spark):
    """2^40 item sets without classes; any of the tokens fires the rule."""
    many = [f"query=f{i:02d}" for i in range(40)]
    rows = [(many + ["path=x"], "block")] * 200 + [(["path=x", f"host={i % 50}"], "allow") for i in range(3800)]
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    block = [r for r in rules.collect() if r["verdict"] == "block"]
    assert [(r["tokens"], r["alike"], r["confidence"]) for r in block] == [([many[0]], [many], 1.0)]
    sets = spark.createDataFrame([(1, [many[7], many[9]]), (2, ["path=x"]), (3, ["none"])], "tokens_id long, tokens array<string>")
    assert {r["tokens_id"]: r["verdict"] for r in urls.fired(sets, rules).collect()} == {1: "block", 2: "allow"}


def test_index_fires_whole_rules_only(spark, monkeypatch):
    rules = spark.createDataFrame(
        [
            (1, ["a", "b"], [["a", "a2"], ["b"]], "block", 0.9, 0.1),
            (2, ["c"], [["c"]], "allow", 0.95, 0.1),
            (3, ["d"], [["d"]], "allow", 0.9, 0.1),
        ],
        "rule_id long, tokens array<string>, alike array<array<string>>, verdict string, confidence double, support double",
    )
    sets = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["a", "b", "d"]), (5, []), (6, ["a", "a2"]), (7, ["a2", "b", "a"])], "tokens_id long, tokens array<string>")
    for limit in (20_000, 0):
        monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
        got = {r["tokens_id"]: r["verdict"] for r in urls.fired(sets, rules).collect()}
        assert got == {2: "block", 3: "allow", 4: "block", 7: "block"}


def test_no_labels_and_no_rows(spark):
    schema = "page_id long, url string, verdict string"
    df = spark.createDataFrame([(1, "http://a.b/c", "x"), (1, "http://a.b/c", "x"), (None, None, None)], schema)
    assert [r["verdict"] for r in urls.judge(df, []).collect()] == ["allow"] * 3
    assert urls.judge(spark.createDataFrame([], schema), URL_RULES).collect() == []


def test_long_and_rare_rules(spark):
    """A rule of five tokens of which no part is one, and one in 0.7 % of the judged URLs."""
    five = ["a", "b", "c", "d", "e"]
    rows = [(five, "block")] * 100
    rows += [([t for t in five if t != x], "allow") for x in five for _ in range(100)]
    rows += [(["rare"], "block")] * 28 + [(["z"], "allow")] * (4000 - 628)
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()
    found = {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in got}
    assert found[tuple(five), "block"] == (1.0, 0.025)
    assert found[("rare",), "block"] == (1.0, 0.007)
