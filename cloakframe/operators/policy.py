"""Policy: banned paths, level checks, layered settings, language routing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.arrays import bind
from cloakframe.functions.patterns import EXTENSION_LANGUAGE
from cloakframe.operators.lookups import lookup, row_weights
from cloakframe.operators.substrings import ID, string_id
from cloakframe.session import materialize


# A glob's tokens: a class ([abc], [!a-z], []]), or one character. A bracket that isn't closed stands for itself.
_TOKEN = r"\[!?+(?:\][^\]]*|[^\]]+)\]|[\s\S]"
_ITEM = r"[\s\S]-[\s\S]|[\s\S]"
_SPECIAL = r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
_ANY = r"[\s\S]"


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression: ``*``, ``?``, ``[…]`` and ``[!…]``."""

    def plain(text: str) -> str:
        return re.sub(_SPECIAL, lambda m: "\\" + m[0], text)

    def one(token: str) -> str:
        if token in ("*", "?"):
            return _ANY + token.replace("?", "")
        if len(token) == 1:
            return plain(token)
        negated = token.startswith("[!")
        items = re.findall(_ITEM, token[1 + negated : -1])
        # A range that runs backwards holds nothing.
        kept = "".join("-".join(plain(c) for c in (x[0], x[2])) if len(x) == 3 else plain(x) for x in items if len(x) < 3 or x[0] <= x[2])
        return f"[{'^' * negated}{kept}]" if kept else _ANY if negated else "(?!)"

    return "^" + "".join(map(one, re.findall(_TOKEN, glob))) + "$"


def glob_regex_of(glob: Column) -> Column:
    """``glob_regex`` for a column of globs."""

    def plain(text: Column) -> Column:
        return F.regexp_replace(text, f"({_SPECIAL})", r"\\$1")

    def item(x: Column) -> Column:
        first, last = F.left(x, F.lit(1)), F.right(x, F.lit(1))
        return F.when(F.length(x) < 3, plain(x)).when(first <= last, F.concat(plain(first), F.lit("-"), plain(last))).otherwise("")

    def one(token: Column) -> Column:
        negated = token.startswith("[!")
        body = F.substring(token, F.when(negated, 3).otherwise(2), F.length(token) - F.when(negated, 3).otherwise(2))
        kept = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_ITEM), F.lit(0)), item), "")
        kind = F.when(kept != "", F.concat(F.lit("["), F.when(negated, "^").otherwise(""), kept, F.lit("]")))
        return (
            F.when(token == "*", _ANY + "*")
            .when(token == "?", _ANY)
            .when(F.length(token) == 1, plain(token))
            .otherwise(F.coalesce(kind, F.when(negated, _ANY).otherwise("(?!)")))
        )

    tokens = F.regexp_extract_all(glob, F.lit(_TOKEN), F.lit(0))
    return F.concat(F.lit("^"), F.array_join(F.transform(tokens, one), ""), F.lit("$"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_banned(path: Column, globs: list[str]) -> Column:
    """True when the path or its last part matches one of the globs."""
    if not globs:
        return F.lit(False)
    anywhere = "|".join(glob_regex(g) for g in globs)
    return path.rlike(anywhere) | base_name(path).rlike(anywhere)


def language_of(path: Column) -> Column:
    """``python``, ``cpp`` or null by file extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    entries = [F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair]
    return F.create_map(*entries)[extension]


POLICY_SCHEMA = (
    "tier string, min_scrub_level int, default_scrub_level int, block_level_1 boolean, "
    "enforce_audit boolean, encrypt_maps boolean, banned_patterns array<string>"
)


def resolve_policy(policies: DataFrame, *keys: str) -> DataFrame:
    """One row (per ``keys``) from the user and repository tiers: the repository can only make it stricter."""

    def of(tier: str, column: str) -> Column:
        return F.when(F.col("tier") == tier, F.col(column))

    user_or = lambda column, default: F.coalesce(F.bool_or(of("user", column)), F.lit(default))
    repo_on = lambda column: F.coalesce(F.bool_or(of("repo", column)), F.lit(False))
    return policies.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.max(of("repo", "min_scrub_level")), F.lit(1)), F.lit(1)).alias("min_scrub_level"),
        F.coalesce(F.max(of("user", "default_scrub_level")), F.lit(2)).alias("default_scrub_level"),
        repo_on("block_level_1").alias("block_level_1"),
        (user_or("enforce_audit", True) | repo_on("enforce_audit")).alias("enforce_audit"),
        (user_or("encrypt_maps", False) | repo_on("encrypt_maps")).alias("encrypt_maps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(of("repo", "banned_patterns"))))).alias(
            "banned_patterns"
        ),
    )


def _grams(text: str, size: int) -> str:
    """SQL: the runs of ``size`` characters of a bound text; one empty run for size 0."""
    if not size:
        return "array('')"
    return f"CASE WHEN length({text}) < {size} THEN array() ELSE transform(sequence(1, length({text}) - {size - 1}), i -> substring({text}, i, {size})) END"


def compiled_globs(globs: DataFrame) -> DataFrame:
    """(glob, regex, size, grams): each distinct glob with the runs of characters that a path must have to match it.

    Runs of three characters where the glob spells out so many in a row, else of two or one; one empty run for a glob
    of wildcards only, which every path has.
    """
    wild = r"\*|\?|\[!?+(?:\][^\]]*|[^\]]+)\]"
    by_size = [f"array_distinct(flatten(transform(s.r, x -> {_grams('x', n)})))" for n in (3, 2, 1)]
    size = f"CASE {' '.join(f'WHEN size({g}) > 0 THEN {n}' for g, n in zip(by_size, (3, 2, 1)))} ELSE 0 END"
    grams = f"CASE {' '.join(f'WHEN size({g}) > 0 THEN {g}' for g in by_size)} ELSE array('') END"
    return globs.where("glob IS NOT NULL").select("glob").distinct().select(
        "glob",
        glob_regex_of(F.col("glob")).alias("regex"),
        bind(size, r=F.split("glob", wild, -1)).alias("size"),
        bind(grams, r=F.split("glob", wild, -1)).alias("grams"),
    )


def banned_paths(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, glob): paths that match a glob, as a whole or by their last part, with the first such glob.

    Each glob is filed under the run of its characters that the fewest paths have (or is out, if no path has one of
    them), and meets only the paths that have that run too; those pairs are verified. So the cost follows the hits and
    not paths times globs, whatever the number of globs.
    """
    rules = materialize(compiled_globs(globs), "globs")
    named = materialize(paths.where("path IS NOT NULL").select("path").distinct().select("path", *string_id(F.col("path"))), "paths")
    sizes = sorted(r["size"] for r in rules.select("size").distinct().collect())  # of 0 to 3
    runs = ", ".join(_grams("s.t", n) for n in sizes) or "array()"
    grams = bind(f"array_distinct(concat({runs}))", t=F.col("path")).cast("array<string>")
    postings = named.select(*ID, F.explode(grams).alias("gram"))
    counts = materialize(row_weights(postings, ["gram"]), "path-grams")
    wanted = rules.select("glob", "regex", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    rarest = lookup(wanted, counts, ["gram"], "inner", "glob", row_weights(wanted, ["gram"])).groupBy("glob", "regex", "n_grams").agg(
        F.count(F.lit(1)).alias("n_found"), F.min(F.struct("n_docs", "gram")).alias("r")
    )
    anchors = materialize(rarest.where("n_found = n_grams").select("r.gram", "glob", "regex"), "anchors")
    pairs = lookup(postings, anchors, ["gram"], "inner", ID[0], counts).drop("gram")
    met = pairs.join(named, ID)
    hit = F.rlike("path", F.col("regex")) | F.rlike(base_name(F.col("path")), F.col("regex"))
    return met.where(hit).groupBy("path").agg(F.min("glob").alias("glob"))


def policy_gate(
    requests: DataFrame, policies: DataFrame, id_col: str, path_col: str = "path", level_col: str = "level"
) -> DataFrame:
    """``requests`` with effective_level, status and reason, by the policies of all tiers (``POLICY_SCHEMA``).

    The tiers are folded to one row first; their globs stay a table. What speaks against a request is told in this
    order: its level, then its path.
    """
    globs = policies.where("tier = 'repo'").select(F.explode("banned_patterns").alias("glob"))
    judged = apply_policy(requests, resolve_policy(policies).drop("banned_patterns"), level_col)
    paths = requests.select(F.col(path_col).alias("path"))
    banned = banned_paths(paths, globs).withColumnRenamed("path", path_col)
    weights = row_weights(requests.where(F.col(path_col).isNotNull()), [path_col])
    met = lookup(judged, banned, [path_col], "left", id_col, weights)
    refused = (F.col("status") == "accepted") & F.col("glob").isNotNull()
    return met.select(
        *requests.columns,
        "effective_level",
        F.when(refused, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(refused, F.concat(F.lit("path matches banned pattern "), "glob")).otherwise(F.col("reason")).alias("reason"),
    )


def apply_policy(requests: DataFrame, policy: DataFrame, level_col: str = "level") -> DataFrame:
    """Effective level, status and reason per request; ``policy`` has exactly one row."""
    minimum = policy.select("min_scrub_level").scalar()
    level = F.coalesce(F.col(level_col), policy.select("default_scrub_level").scalar())
    blocked = policy.select("block_level_1").scalar() & (level == 1)
    below = level < minimum
    return (
        requests.withColumn("effective_level", level)
        .withColumn("status", F.when(blocked | below, "rejected").otherwise("accepted"))
        .withColumn(
            "reason",
            F.when(blocked, "level 1 is blocked")
            .when(below, F.concat(F.lit("minimum level is "), minimum.cast("string")))
            .otherwise(""),
        )
    )


def policy_row(spark: SparkSession, **values) -> DataFrame:
    """A policy given in code, for callers that keep none in a table."""
    row = {
        "min_scrub_level": 1,
        "default_scrub_level": 2,
        "block_level_1": False,
        "enforce_audit": True,
        "encrypt_maps": False,
        "banned_patterns": [],
        **values,
    }
    return spark.createDataFrame([row], POLICY_SCHEMA.replace("tier string, ", ""))
