"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more letters, digits and ``+/_-``, with the ``=`` that pad it, or a value of 6 or more characters
assigned to a name such as token or password (``NAMED``), quoted or not, also behind ``Bearer``. A quoted value ends at its quotation mark
or a blank, others at a blank, quotation mark, bracket or one of ``,;&``, in a URL's query also at ``#``. Its features: length, shares of digits, capitals,
small letters and signs, changes between these kinds, letters that differ, how likely its character transitions are
in secrets against other findings (learned), how much of it is covered by letter triples of the documents' words
(dictionary coverage), words and signs before it, a quotation mark behind it, and its path (the column ``path``).

The forest is trained on labelled findings: rows (value, before, after, path, label). Where none are given they are
derived from the corpus: a value assigned to a name such as token, password or api_key is a secret, unless it is a word
of fewer than 16 letters only (it may be a type or a person); a word of letters only, or a number, without such a name is
none; all others have no label. At most about ``SAMPLE`` distinct findings of each
label are used, chosen by a hash of the whole finding.

All of it is DataFrame operations and Spark's forest; no Python on the executors. Null and empty texts have no candidates.
Repeated rows give repeated findings. A null path counts as empty. Without findings of both labels a candidate's score is 1 if
such a name stands before it, else 0. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind, gaps_of, pieces_of, sql_let, sql_sums
from cloakframe.llm.common import bounded_sample, whole_text
from cloakframe.session import materialize

BEFORE, AFTER = 40, 8
SAMPLE = 4000
TREES, TREE_DEPTH, SEED = 40, 7, 11
THRESHOLD = 0.5

# Names that a secret is assigned to, and other words beside a finding or in its path.
NAMED = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)"
_SCHEME = r"(bearer|basic|token)\s"
ASSIGNED = NAMED + rf"[a-z0-9_]*[\"']?\]?\s*(=|:|=>|:=)\s*({_SCHEME}+)?[\"'`]?$"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|checksum|sha1|sha256|md5|commit|uuid)"
TEST_PATH = r"(?i)(test|example|doc|fixture|readme)"

LEAST_RUN, LEAST_VALUE = 16, 6
_RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}+(?:={{1,2}}+(?![A-Za-z0-9+/_-]))?+"
# Right behind an assignment; the first two look back a few characters only and are false at nearly all places.
_BEHIND = (
    r"(?<=[=:>\s\"'`])(?<=[=:>]\s{0,3}[\"'`]?|(?i:bearer|basic|token)\s{1,3}[\"'`]?)"
    rf"(?<={NAMED.replace('(?i)(', '(?i:')}[A-Za-z0-9_]{{0,64}}[\"']?\]?\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}(?:(?i:bearer|basic|token)\s{{1,3}})?[\"'`]?)"
    rf"(?!(?i:{_SCHEME}))"
)
_VALUE = "|".join(
    [
        *(rf"(?<={q})[^{q}\s]{{{LEAST_VALUE},}}+" for q in "\"'`"),
        rf"(?<=[?&][A-Za-z0-9_.-]{{1,64}}=)[^\s\"'`<>()\[\]{{}},;&#]{{{LEAST_VALUE},}}+",
        rf"(?<![\"'`]|[?&][A-Za-z0-9_.-]{{1,64}}=)[^\s\"'`<>()\[\]{{}},;&]{{{LEAST_VALUE},}}(?<![.:])",
    ]
)
PATTERN = f"{_BEHIND}(?:{_VALUE})|{_RUN}"

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_KINDS = 29  # letters, any digit, any capital, any sign
FEATURES = [
    "size", "digits", "capitals", "smalls", "signs", "changes", "distinct", "hex", "transition", "coverage",
    "named", "assigned", "harmless", "quoted", "closed", "alone", "test_path", "path_part",
]


def candidates(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, path, start, end, value, before, after) per candidate; offsets in code points."""
    widths = "zip_with(s.p, slice(s.g, 1, size(s.p)), (p, g) -> length(p) + length(g))"
    # The name of a value may be a candidate itself, so what stands before reaches over candidates: so many have BEFORE characters.
    many = -(-BEFORE // LEAST_VALUE)
    last = f"greatest(1, i - {many - 1}), least(i, {many})"
    over = f"zip_with(slice(s.g, {last}), slice(s.p, {last}), (x, y) -> concat(right(x, {BEFORE}), right(y, {BEFORE})))"
    rows = (
        "transform(s.p, (p, i) -> named_struct('value', p, 'start', o[i] + length(s.g[i]), "
        f"'before', right(concat(array_join({over}, ''), s.g[i]), {BEFORE}), 'after', left(s.g[i + 1], {AFTER})))"
    )
    text = F.col("_text")
    found = bind(sql_let(widths, "w", sql_let(sql_sums("w"), "o", rows)), g=gaps_of(text, PATTERN), p=pieces_of(text, PATTERN))
    given = docs.select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), whole_text().alias("_text"))
    return (
        given.where(F.col("_text").rlike(f"[A-Za-z0-9+/_-]{{{LEAST_RUN}}}") | F.col("_text").rlike(NAMED))
        .select("doc_id", "path", F.explode(found).alias("f"))
        .select("doc_id", "path", "f.start", (F.col("f.start") + F.length("f.value")).alias("end"), "f.value", "f.before", "f.after")
    )


def derived_labels(found: DataFrame) -> DataFrame:
    """The candidates that carry a label by where they stand, with it."""
    plain = F.col("value").rlike("^([A-Za-z]+|[0-9]+)$")
    short = F.col("value").rlike("^[A-Za-z]+$") & (F.length("value") < LEAST_RUN)
    label = F.when(F.col("before").rlike(ASSIGNED) & ~short, 1).when(plain & ~F.col("before").rlike(NAMED), 0)
    return found.withColumn("label", label).where("label IS NOT NULL")


def _table(values: list[float]) -> Column:
    """A constant array, folded to a literal by the optimizer."""
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<double>")


def _codes(value: Column) -> Column:
    """One number per character: small letter, digit, capital, sign."""
    plain = F.translate(F.regexp_replace(value, "[A-Z]", "^"), "0123456789", "0" * 10)
    return F.transform(
        F.filter(F.split(plain, ""), lambda c: c != ""),
        lambda c: F.when(c == "0", 26).when(c == "^", 27).when(c.between("a", "z"), F.ascii(c) - 97).otherwise(28),
    )


_PAIRS = f"CASE WHEN size(s.c) < 2 THEN array() ELSE transform(sequence(1, size(s.c) - 1), i -> s.c[i - 1] * {_KINDS} + s.c[i]) END"
_TRIPLES = (
    "CASE WHEN size(s.c) < 3 THEN array() ELSE transform(sequence(2, size(s.c) - 1), i -> "
    "IF(s.c[i - 2] < 26 AND s.c[i - 1] < 26 AND s.c[i] < 26, (s.c[i - 2] * 26 + s.c[i - 1]) * 26 + s.c[i], -1)) END"
)


def transition_odds(labelled: DataFrame) -> list[float]:
    """log odds of each character transition in secrets against other findings."""
    pairs = labelled.select("label", F.explode(bind(_PAIRS, c=_codes(F.col("value")))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}
    total = [sum(n for (y, _), n in counts.items() if y == k) for k in (0, 1)]

    size = _KINDS * _KINDS
    return [
        math.log((counts.get((1, p), 0) + 1) / (total[1] + size)) - math.log((counts.get((0, p), 0) + 1) / (total[0] + size))
        for p in range(size)
    ]


def word_triples(docs: DataFrame) -> list[int]:
    """1 for each letter triple that is common in words of all documents.

    Words are combined on the map side, then their triples, of which there are 26^3 at most.
    """
    letters = F.lower(F.regexp_replace(whole_text(), r"[A-Za-z0-9+/_=-]{16,}+", " "))
    words = docs.select(F.explode(F.split(letters, "[^a-z]++")).alias("w")).where(F.length("w") >= 3)
    words = words.groupBy("w").count()
    triples = words.select("count", F.explode(bind(_TRIPLES, c=_codes(F.col("w")))).alias("t")).where("t >= 0")
    counts = {r["t"]: r["n"] for r in triples.groupBy("t").agg(F.sum("count").alias("n")).collect()}
    least = sum(counts.values()) / 26**3 / 2
    return [int(counts.get(t, 0) > least) for t in range(26**3)]


def with_features(found: DataFrame, odds: list[float], triples: list[int]) -> DataFrame:
    value, before = F.col("value"), F.col("before")
    size = F.length(value)

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, pattern, "")) / size

    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]++", "#"), "[a-z]++", "a"), "[A-Z]++", "B"), "[0-9]++", "0"
    )
    codes = found.withColumn("_codes", _codes(value))
    pairs, covered = bind(_PAIRS, c=F.col("_codes")), bind(_TRIPLES, c=F.col("_codes"))
    likely = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.get(_table(odds), p))
    known = F.aggregate(covered, F.lit(0.0), lambda a, t: a + F.when(t >= 0, F.get(_table(triples), t)).otherwise(0.0))
    made = {
        "size": F.log(size.cast("double")),
        "digits": share("[^0-9]"),
        "capitals": share("[^A-Z]"),
        "smalls": share("[^a-z]"),
        "signs": share("[A-Za-z0-9]"),
        "changes": (F.length(kinds) - 1) / size,
        "distinct": F.size(F.array_distinct("_codes")) / F.least(size, F.lit(_KINDS)),
        "hex": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "transition": likely / size,
        "coverage": known / size,
        "named": before.rlike(NAMED).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "harmless": F.concat(before, F.col("after")).rlike(HARMLESS).cast("double"),
        "quoted": before.rlike("[\"'`]$").cast("double"),
        "closed": F.col("after").rlike("^[\"'`]").cast("double"),
        "alone": before.rlike(r"(^|\s)$").cast("double"),
        "test_path": F.col("path").rlike(TEST_PATH).cast("double"),
        "path_part": F.pmod(F.xxhash64("path"), F.lit(16)).cast("double"),
    }
    return codes.withColumns({f"x_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in made.items()}).drop("_codes")




def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"x_{n}" for n in FEATURES], outputCol="_features").transform(rows)


def train(labelled: DataFrame, odds: list[float], triples: list[int]) -> RandomForestClassificationModel:
    """The forest; rows (distinct) are dealt and ordered by all their columns, so that the same findings give the same trees."""
    whole = ["value", "before", "after", "path", "label"]
    rows = _vectors(with_features(labelled, odds, triples)).select(*whole, "_features").withColumn("label", F.col("label").cast("double"))
    ordered = rows.repartition(6, *whole).sortWithinPartitions(*whole)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="_features", numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, probabilityCol="_p",
        rawPredictionCol="_raw", predictionCol="_said",
    )
    return forest.fit(ordered.select("label", "_features"))


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, value_sha256, score, secret) for every candidate of every text."""
    found = materialize(candidates(docs, path), "candidates")
    given = labelled if labelled is not None else derived_labels(found)
    given = given.select("value", "before", "after", F.coalesce("path", F.lit("")).alias("path"), "label").distinct()
    kinds = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    hidden = F.sha2("value", 256).alias("value_sha256")
    if not kinds.get(0) or not kinds.get(1):
        score = F.col("before").rlike(ASSIGNED).cast("double")
        return found.select("doc_id", "start", "end", hidden, score.alias("score"), (score >= THRESHOLD).alias("secret"))
    sample = materialize(
        bounded_sample(given.where("label = 1"), SAMPLE).unionByName(bounded_sample(given.where("label = 0"), SAMPLE)),
        "findings",
    )
    odds, triples = transition_odds(sample), word_triples(docs)
    forest = train(sample, odds, triples)
    scored = forest.transform(_vectors(with_features(found, odds, triples)))
    score = F.round(vector_to_array("_p")[1], 9)
    return scored.select("doc_id", "start", "end", hidden, score.alias("score")).withColumn("secret", F.col("score") >= THRESHOLD)
