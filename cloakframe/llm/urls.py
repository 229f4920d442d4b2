"""URL filter: a given rule list decides first, association rules mined from judged URLs decide the rest.

A rule is (host, path, verdict). It fits its host and all subdomains if the path of the URL starts with the rule's;
the longest fitting rule wins. The URLs that a rule decides are the labelled ones.

For the others, tokens of a URL (host labels with their distance from the end, words of the path and of the query,
file ending, scheme) are items. FP-growth mines token combinations that occur with a verdict; a rule
"these tokens -> verdict" is kept with enough support and confidence, unless a part of its tokens already gives the same verdict
with no less confidence; rules may have any number of tokens. Rules are matched by an inverted index from token to rule: a rule fires when all its
tokens are met. Tokens that stand on the same judged URLs are one item while mining and stand for each other in a rule. The most confident fired rule decides, then the one with more support, then block before allow; without a
fired rule the verdict is allow.

Only DataFrame operations and Spark's FP-growth are used. Null URLs and those without "://" have an empty host and path
and no tokens. Repeated rows and ids are judged row by row; extra columns are ignored; empty tables give empty results. Without
labelled URLs there are no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.lookups import lookup
from cloakframe.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.005
LEAST_ROWS = 20  # judged URLs behind a rule, however small the table
MIN_CONFIDENCE = 0.8
BROADCAST_RULES = 20_000
SALTS = 64


def parts(url: Column) -> dict[str, Column]:
    """scheme, host, path and query of a URL; all empty without "://"."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    authority = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    after = F.substring(rest, F.length(authority) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*+", 0)
    return {
        "scheme": F.when(at > 0, F.translate(F.substring(text, F.lit(1), at - 1), UPPER, LOWER)).otherwise(""),
        "host": F.translate(authority, UPPER, LOWER),
        "path": path,
        "query": F.regexp_extract(F.substring(after, F.length(path) + 1, F.length(after)), r"^\?([^#]*)", 1),
    }


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null without one. The list is part of the plan."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        h = rule_host.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.reverse(F.split(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\."))
    words = F.split(F.lower(path), r"[^\p{L}\p{N}]+")
    numbered = F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("digits"), F.length(w).cast("string"))).otherwise(w))
    fields = F.transform(F.split(query, "&"), lambda q: F.split(q, "=")[0])
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    all_of = F.concat(
        F.array(F.concat(F.lit("scheme="), scheme)),
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x)),
        F.transform(F.filter(hyphened, lambda x: x != ""), lambda x: F.concat(F.lit("name="), x)),
        F.transform(F.filter(numbered, lambda w: w != ""), lambda w: F.concat(F.lit("path="), w)),
        F.transform(F.filter(fields, lambda q: q != ""), lambda q: F.concat(F.lit("query="), q)),
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_of))


def token_classes(judged: DataFrame, least: float) -> DataFrame:
    """(token, alike): tokens on ``least`` and more of the rows (_row, tokens), those on the same rows as one class.

    A class is named by its smallest token. Rows are compared by their number and 128 bits of hash over their ids. Tokens that
    always come together, as the fields of one query string do, would else make an item set of every subset of theirs.
    """
    each = judged.select("_row", F.explode(F.array_distinct("tokens")).alias("t"))
    seen = each.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "_row")).alias("b")
    )
    grouped = seen.where(F.col("n") >= least).groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("t")).alias("alike"))
    return materialize(grouped.select(F.get("alike", F.lit(0)).alias("token"), "alike"), "token-classes")


def mine(judged: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, alike, verdict, confidence, support) from (tokens, verdict) rows.

    ``alike`` has for each token of a rule those that stand on the same rows, itself included: the rule holds for any of
    them in its place. Two tokens of one class are never in a rule, as the rule with one of them is as confident.
    """
    spark = judged.sparkSession
    judged = materialize(judged.select("tokens", "verdict", F.monotonically_increasing_id().alias("_row")), "judged")
    total = judged.count()
    empty = "rule_id long, tokens array<string>, alike array<array<string>>, verdict string, confidence double, support double"
    if not total:
        return spark.createDataFrame([], empty)
    min_support = max(min_support, LEAST_ROWS / total)
    if min_support > 1:
        return spark.createDataFrame([], empty)
    classes = token_classes(judged, min_support * total)
    each = judged.select("_row", F.explode(F.array_distinct("tokens")).alias("t"))
    named = classes.select("token", F.explode("alike").alias("t"))  # at most (tokens of a URL) / min_support
    items = each.join(named, "t").groupBy("_row").agg(F.collect_set("token").alias("held"))
    own = F.coalesce("held", F.array().cast("array<string>"))
    baskets = judged.select("_row", "verdict").join(items, "_row", "left").select(
        F.concat(own, F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    said = F.filter("items", lambda t: t.startswith("verdict="))
    sets = model.freqItemsets.select(
        F.array_sort(F.array_except("items", said)).alias("tokens"), F.substring(F.get(said, F.lit(0)), 9, 99).alias("verdict"), "freq"
    ).where(F.size("tokens") > 0)
    of = sets.where("verdict IS NULL").select("tokens", F.col("freq").alias("of"))
    rules = materialize(
        sets.where("verdict IS NOT NULL").join(of, "tokens").select(
            "tokens", "verdict", F.size("tokens").alias("n"), (F.col("freq") / F.col("of")).alias("confidence"),
            (F.col("freq") / total).alias("support"), F.xxhash64("tokens", "verdict").alias("rule_id"),
        ),
        "mined",
    )
    # A longer rule goes if a part of it is as confident. Every part is frequent too, so the most confident one comes up by length.
    longest = rules.agg(F.max("n")).first()[0] or 0
    kept, parts_best = None, None
    for n in range(1, longest + 1):
        level = rules.where(F.col("n") == n)
        if parts_best is None:
            level = level.withColumn("part", F.lit(-1.0))
        else:
            without = F.transform("tokens", lambda t: F.xxhash64(F.filter("tokens", lambda x: x != t), "verdict"))
            best = level.select("rule_id", F.explode(without).alias("less")).join(parts_best, "less").groupBy("rule_id").agg(F.max("best").alias("part"))
            level = level.join(best, "rule_id")
        level = materialize(level, "rules_of_a_length")
        own = level.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("part")))
        kept = own if kept is None else kept.unionByName(own)
        parts_best = level.select(F.col("rule_id").alias("less"), F.greatest("confidence", "part").alias("best"))
    if kept is None:
        return spark.createDataFrame([], empty)
    kept = materialize(kept.select("rule_id", "tokens", "verdict", "confidence", "support"), "kept-rules")
    wide = kept.select("rule_id", F.posexplode("tokens").alias("pos", "token")).join(classes, "token")
    wide = wide.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("pos", "alike"))).alias("a"))
    return kept.join(wide, "rule_id").select("rule_id", "tokens", F.col("a.alike").alias("alike"), "verdict", "confidence", "support")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens_id, verdict): what the mined rules say about each distinct set of tokens (tokens_id, tokens)."""
    rules = materialize(rules, "rules")
    of_rule = ["rule_id", "verdict", "confidence", "support"]
    index = rules.select(*of_rule, F.size("tokens").alias("n"), F.posexplode("alike").alias("pos", "a")).select(
        *of_rule, "n", F.expr("shiftleft(1L, pos)").alias("bit"), F.explode("a").alias("t")
    )
    each = urls.select("tokens_id", F.explode("tokens").alias("t"))
    if index.count() <= BROADCAST_RULES:
        met = each.join(F.broadcast(index), "t")
    else:
        salted = each.withColumn("_salt", F.pmod(F.xxhash64("tokens_id"), F.lit(SALTS)).cast("int"))
        copies = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(copies, ["t", "_salt"])
    whole = (
        met.groupBy("tokens_id", "rule_id")
        .agg(F.bit_count(F.bit_or("bit")).alias("met"), F.first("n").alias("n"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
        .where("met = n")
    )
    order = F.struct("confidence", "support", (F.col("verdict") == "block").alias("b"))
    return whole.groupBy("tokens_id").agg(F.max_by("verdict", order).alias("verdict"))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls`` (id, url)."""
    named = urls.select(F.col(id_col), *[c.alias(n) for n, c in parts(F.col("url")).items()])
    ruled = named.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "tokens", F.array_sort(tokens(*[F.col(c) for c in ("scheme", "host", "path", "query")]))
    )
    read = materialize(
        ruled.select(
            id_col, "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("given"), "tokens",
            F.xxhash64("tokens").alias("tokens_id"),
        ),
        "urls",
    )
    mined = mine(read.where("given IS NOT NULL").select("tokens", F.col("given").alias("verdict")))
    # URLs with the same tokens are judged once; each row finds its verdict again by the id.
    open_sets = read.where("given IS NULL").groupBy("tokens_id").agg(F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    said = fired(open_sets, mined).withColumnRenamed("verdict", "mined")
    joined = lookup(read, said, ["tokens_id"], spread=id_col, weights=open_sets.select("tokens_id", "n_docs"))
    return joined.select(id_col, "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"))
