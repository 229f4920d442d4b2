import datetime as dt
import fnmatch
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import audit, policy, risk


def test_globs_match_like_fnmatch(spark):
    globs = ["*.key", "*credentials*", "src/?.py", "[ab]*.txt", "[!a]x", "a.b", "*[0-9]"]
    paths = ["x.key", "dir/x.key", "my_credentials.txt", "src/a.py", "src/ab.py", "b1.txt", "cx", "ax", "aXb", "a.b", "d/a.b", "n7", "k.ey"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for glob in globs:
        got = {r.path for r in df.where(policy.is_banned(F.col("path"), [glob])).collect()}
        want = {p for p in paths if fnmatch.fnmatchcase(p, glob) or fnmatch.fnmatchcase(p.split("/")[-1], glob)}
        assert got == want, glob
    assert df.where(policy.is_banned(F.col("path"), [])).isEmpty()


def test_languages(spark):
    df = spark.createDataFrame([("a/b.py",), ("x.HPP",), ("y.c",), ("z.txt",), ("noext",)], "path string")
    assert [r.l for r in df.select(policy.language_of(F.col("path")).alias("l")).collect()] == ["python", "cpp", "cpp", None, None]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([], (1, 2, False, True, False, [])),
        (
            [("user", None, 3, None, False, True, None), ("repo", 2, None, True, None, None, ["b", "a"])],
            (2, 3, True, False, True, ["a", "b"]),
        ),
        (
            [("user", 4, None, True, False, None, ["u"]), ("repo", None, 1, None, True, None, None)],
            (1, 2, False, True, False, []),
        ),
    ],
)
def test_policy_tiers(spark, rows, want):
    row = policy.resolve_policy(spark.createDataFrame(rows, policy.POLICY_SCHEMA)).head()
    assert tuple(row) == want


def test_levels(spark):
    requests = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "id int, level int")
    rules = policy.policy_row(spark, min_scrub_level=3, default_scrub_level=2, block_level_1=True)
    rows = policy.apply_policy(requests, rules).orderBy("id").collect()
    assert [(r.effective_level, r.status, r.reason) for r in rows] == [
        (1, "rejected", "level 1 is blocked"),
        (2, "rejected", "minimum level is 3"),
        (3, "accepted", ""),
        (2, "rejected", "minimum level is 3"),
    ]


HITS = {
    "matrix/2D array indexing": "a[i] [j]",
    "exponential function (exp)": "y = exp (x)",
    "sorting operation": "std::sort(a)",
    "recursive function": "def f(x):\n  y\n  return f(x)",
    "loop iteration": "while(true)",
    "file I/O operations": "open('x')",
    "network I/O": "requests.get(u)",
    "cryptographic operations": "use SHA256 here",
    "ML training loop": "loss",
    "database operations": "SELECT x",
    "threshold/boundary check": "if (x >= y",
}
MISSES = ["a[i] + b", "texp(x)", "resort(", "def f(x):\n  y\n  return g(x)", "forest (", "reopen(", "resend(", "sha2567", "lossy", "selected", "if x"]


def test_structures(texts):
    rows = texts(*HITS.values()).orderBy("doc_id").select(risk.structures_in(F.col("text")).alias("s")).collect()
    for name, row in zip(HITS, rows):
        assert name in row.s
    assert all(r.s == [] for r in texts(*MISSES).select(risk.structures_in(F.col("text")).alias("s")).collect())


@pytest.mark.parametrize(
    "case,want",
    [
        ((1, 0, False, 0, 0), (3, "MEDIUM")),
        ((1, 1, False, 0, 0), (4, "HIGH")),
        ((2, 0, False, 0, 0), (0, "LOW")),
        ((2, 1, False, 0, 0), (1, "LOW")),
        ((2, 5, False, 1, 0), (1, "LOW")),
        ((2, 6, False, 1, 0), (2, "MEDIUM")),
        ((2, 6, False, 2, 0), (3, "MEDIUM")),
        ((2, 6, False, 3, 1), (4, "HIGH")),
        ((2, 0, False, 4, 0), (2, "MEDIUM")),
        ((3, 0, False, 0, 0), (1, "LOW")),
        ((3, 0, True, 0, 0), (0, "LOW")),
    ],
)
def test_exposure(spark, case, want):
    df = spark.createDataFrame([case], "level int, flagged int, isolated boolean, n int, w int")
    score, level, reasons = risk.exposure(*[F.col(c) for c in df.columns])
    row = df.select(score.alias("s"), level.alias("l"), reasons.alias("r")).head()
    assert (row.s, row.l) == want
    assert (row.r == ["nothing left in the open"]) == (want[0] == 0)


def test_report_and_json(spark, texts):
    symbols = spark.createDataFrame([(1, k) for k in ("variable", "method", "struct", "enum_constant", "string")], "doc_id long, kind string")
    report = risk.risk_report(texts("x = open('a')"), 2, counts=risk.symbol_counts(symbols))
    data = json.loads(risk.report_json(report).head().report)
    assert data["symbols_by_kind"] == {"variables": 2, "functions": 1, "types": 1, "constants": 0, "strings": 1, "macros": 0}
    assert data["patterns_detected"] == ["file I/O operations"] and data["exposure_level"] == "LOW"
    assert data["total_symbols"] == 5


def _log(spark):
    t = dt.datetime(2024, 1, 1, 10)
    base = {f.split()[0]: None for f in audit.ENTRY_SCHEMA.split(", ")}
    rows = [
        {**base, "timestamp": t, "action": "hide", "source_files": ["a/b.py", "c.py"], "scrub_level": 2, "symbols_scrubbed": 3,
         "literals_scrubbed": 0, "warning_count": 1, "ghost_output_hash": "0123456789"},
        {**base, "timestamp": t + dt.timedelta(days=1), "action": "reveal", "input_file": "x/y.md", "symbols_restored": 4,
         "confidence": "LOW", "annotations": 2, "output_hash": "abcdef0123", "new_symbols_detected": 0},
        {**base, "timestamp": t, "action": "hide", "symbols_scrubbed": 0, "symbols_restored": 7, "source_files": []},
    ]
    return spark.createDataFrame([tuple(r[c] for c in base) for r in rows], audit.ENTRY_SCHEMA)


def test_totals_recent_and_details(spark):
    log = _log(spark)
    assert tuple(audit.totals(log).head()) == (2, 1, 14)
    assert [r.action for r in audit.recent(log, 1).collect()] == ["reveal"]
    rows = {(r.action, r.files): (r.details, r.warnings, r.hash) for r in audit.detail_lines(log).collect()}
    assert rows[("hide", "b.py, c.py")] == ("Level 2 · 3 symbols", "1 warning", "01234567")
    assert rows[("reveal", "y.md")] == ("4 restored · LOW confidence · 2 annotations", "", "abcdef01")
    assert audit.detail_lines(log, "reveal").count() == 1


def test_entries(spark, texts):
    hide = audit.hide_entries(texts("abc"), 2, "doc_id").head()
    assert hide.ghost_output_hash == hashlib.sha256(b"abc").hexdigest()
    assert (hide.action, hide.scrub_level, hide.symbols_scrubbed, hide.source_files) == ("hide", 2, 0, ["1"])
    missing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert audit.reveal_entries(missing, "doc_id", "m", "code").head().output_hash == "unavailable"


GLOBS = [
    "*.py", "src/*", "*/fr/*", "??", "*", "", "[!a-c]*", "[]x]*", "[[]y", "a[&&b]c", "[^a]*", "[a^]z", "[z-a]*", "[!z-a]?", "[a-", "x[!]", "*a-c[--0]*",
    "[-a]*", "[a-]*", "é*", "*ü?", "a.b+c(d)", "lib/[a-c]*[0-9].h", "a\\\\b", "*[\\\\]*", "*#top", "$HOME/{x}|y", "[a-c-e]*",
]
PATHS = [
    "", "a", "ab", "abc", "b", "z", "]x", "x", "[y", "a&c", "abc/a&c", "^", "az", "^z", "src/main.py", "lib/a7.h", "lib/d7.h", "x/fr/y", "[a-", "x[!]", "a-c/0", "a-c.",
    "-q", "é1", "düd", "a.b+c(d)", "a\\\\b", "page#top", "$HOME/{x}|y", "e", "d", "line\nbreak", "x/", "c-",
]


def test_globs_equal_the_shell_ones(spark):
    """One by one as patterns, compiled in a column, and as a table joined by runs of characters."""

    def plain(path, glob):
        return fnmatch.fnmatchcase(path, glob) or fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], glob)

    globs = spark.createDataFrame([(g,) for g in GLOBS] + [(None,), ("*",)], "glob string")
    paths = spark.createDataFrame([(p,) for p in PATHS] + [(None,), ("a",)], "path string")
    compiled = {r.glob: r.regex for r in policy.compiled_globs(globs).collect()}
    assert compiled == {g: policy.glob_regex(g) for g in GLOBS}
    for g in GLOBS:
        got = {r.path for r in paths.where(policy.is_banned(F.col("path"), [g])).collect()}
        assert got == {p for p in PATHS if plain(p, g)}, g
    for some in (GLOBS, [g for g in GLOBS if g != "*"], ["*.py", "[!z-a]?"], []):
        found = policy.banned_paths(paths, globs.where(F.col("glob").isin(some)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = {r.path: r.glob for r in found.collect()}
        assert got == {p: min(g for g in some if plain(p, g)) for p in PATHS if any(plain(p, g) for g in some)}


def test_gate_tells_the_level_first(spark):
    policies = spark.createDataFrame(
        [("user", None, 3, None, None, None, None), ("repo", 2, None, True, None, None, ["*.key"]), ("repo", None, None, None, None, None, ["secret/*"])],
        policy.POLICY_SCHEMA,
    )
    rows = [(1, "a.key", 1), (2, "a.key", 2), (3, "secret/b", None), (4, "ok.py", 1), (5, "ok.py", None), (6, None, 4)]
    out = policy.policy_gate(spark.createDataFrame(rows, "id long, path string, level int"), policies, "id")
    assert {r.id: (r.effective_level, r.status, r.reason) for r in out.collect()} == {
        1: (1, "rejected", "level 1 is blocked"),
        2: (2, "rejected", "path matches banned pattern *.key"),
        3: (3, "rejected", "path matches banned pattern secret/*"),
        4: (1, "rejected", "level 1 is blocked"),
        5: (3, "accepted", ""),
        6: (4, "accepted", ""),
    }


def test_recursion_by_self_edges(spark):
    cases = {
        "def f(a):\n    return f(a - 1)\n": True,
        "def f(a): return f(a)\n": False,
        "def f(a):\n    return g(a)\n\ndef g(b):\n    return 1\n": False,
        "def f(a):\n    return 1\n\ndef g(b):\n    return f(b)\n": True,
        "f(1)\ndef f(a):\n    return 2\n": False,
        "def f(a,\n      b):\n    pass\nx = f (1, 2)\n": True,
        "def f(a):\n    return xf(a) + f2(a)\n": False,
        "no code": False,
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want boolean")
    for r in df.select("text", "want", risk.structures_in(F.col("text")).alias("s")).collect():
        assert ("recursive function" in r.s) == r.want, r.text
    many = "".join(f"def f{i}(a):\n    return g{i}(a)\n" for i in range(50_000))
    df = spark.createDataFrame([(many,), (many + "f0(1)\n",)], "text string")
    assert [r.s for r in df.select(risk.calls_itself(F.col("text")).alias("s")).collect()] == [False, True]
