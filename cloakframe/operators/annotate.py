"""Notes on a restored explanation: advice about masked names, guesses about stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import let, pieces_of, with_offsets
from cloakframe.functions.patterns import WORD
from cloakframe.operators.dictionary import reverse_map
from cloakframe.operators.lookups import lookup, row_weights
from cloakframe.session import materialize

_N = r"`?(?<![\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]*+)`?"

# Phrases that comment on a name.
NAMING_ADVICE = [
    rf"(?i)(?:rename|renaming)\s+{_N}",
    rf"(?i){_N}\s+(?:is a |has a )?(?:misleading|confusing|unclear|bad|poor)\s+(?:name|naming)",
    rf"(?i)(?:consider|try|suggest)\s+(?:calling|naming|renaming)\s+{_N}",
    rf"(?i)(?:better|clearer|more descriptive)\s+name\s+(?:for|than)\s+{_N}",
    rf"(?i){_N}\s+(?:should|could|might)\s+be\s+(?:renamed|called|named)",
    rf"(?i)(?:variable|function|class|method)\s+name\s+{_N}",
]

# Phrases are tried only where a letter stands that one of them starts with.
# Phrases that guess; the last two speak about a certain name.
SPECULATION = [
    r"(?i)(?=[mclp])(?:might|may|could|probably|likely|possibly)\s+(?:be |cause |have |return |throw )",
    r"(?i)(?=[ihw])(?:I'm not sure|it's unclear|hard to tell|without seeing)",
    r"(?i)(?=[aib])(?:assuming|if I had to guess|based on the name)",
]
SPECULATION_ABOUT = [
    rf"(?i)(?=[tiw])(?:the implementation of|inside|within)\s+{_N}",
    rf"(?i)(?=[mvce])(?:make sure|verify|check|ensure)\s+(?:that\s+)?{_N}",
]

SENTENCE = r"[^.!?\n]+"
CUT = 150


def cut(sentence: Column) -> Column:
    trimmed = F.regexp_replace(sentence, r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) > CUT, F.concat(F.left(trimmed, F.lit(CUT)), F.lit("..."))).otherwise(trimmed)


def sentences(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Sentences of a text in order, trimmed and cut."""
    found = F.filter(F.transform(pieces_of(F.col(text_col), SENTENCE), cut), lambda s: s != "")
    return docs.select(*id_cols, F.posexplode(found).alias("nth", "sentence")).select(
        *id_cols, F.col("nth").cast("bigint").alias("nth"), "sentence"
    )


def _hits(text: Column, patterns: list[str], with_name: bool) -> Column:
    """array<struct<template, name, offset>> for all phrases found; texts without any cost one scan."""
    kind = "array<struct<template:int,name:string,offset:int>>"
    empty = F.array().cast(kind)

    def found(number: int, pattern: str) -> Column:
        name = (lambda piece: F.regexp_extract(piece, pattern, 1)) if with_name else (lambda piece: F.lit(""))
        hits = F.transform(
            with_offsets(text, pattern),
            lambda o: F.struct(
                F.lit(number).alias("template"), name(o["piece"]).alias("name"), o["offset"].alias("offset")
            ),
        )
        return F.when(text.rlike(pattern), hits.cast(kind)).otherwise(empty)

    return F.concat(*[found(n, pattern) for n, pattern in enumerate(patterns, 1)])


def _phrases(docs: DataFrame, patterns: list[str], with_name: bool, id_cols: list[str], text_col: str) -> DataFrame:
    """(ids, template, name, offset, sentence): every phrase found, with the sentence around it."""
    text = F.col(text_col)
    found = docs.select(*id_cols, text.alias("_text"), _hits(text, patterns, with_name).alias("_hits"))
    none = F.array().cast("array<struct<template:int,name:string,offset:int,sentence:string>>")

    def around(hits: Column, all_: Column) -> Column:
        def sentence(h: Column) -> Column:
            holding = F.filter(all_, lambda s: (s["offset"] <= h["offset"]) & (s["end_offset"] > h["offset"]))
            return cut(F.coalesce(F.get(holding, F.lit(0))["piece"], F.lit("")))

        return F.transform(
            hits,
            lambda h: F.struct(
                h["template"].alias("template"),
                h["name"].alias("name"),
                h["offset"].alias("offset"),
                sentence(h).alias("sentence"),
            ),
        )

    with_sentences = let(
        F.col("_hits"),
        lambda hits: F.when(F.size(hits) == 0, none).otherwise(
            let(with_offsets(F.col("_text"), SENTENCE), lambda all_: around(hits, all_))
        ),
    )
    return found.select(*id_cols, F.explode(with_sentences).alias("h")).select(*id_cols, "h.*")


def naming_advice(docs: DataFrame, dictionary: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Advice about names that were tokens: the first hit per document, name and phrase.

    Names are compared without regard to case, as whole words; a name with several tokens is
    spoken of under its last one.
    """
    hits = materialize(
        _phrases(docs, NAMING_ADVICE, True, id_cols, text_col)
        .withColumn("key", F.lower("name"))
        .groupBy(*id_cols, "key", "template")
        .agg(F.min_by("sentence", "offset").alias("sentence")),
        "advice",
    )
    names = reverse_map(dictionary).withColumn("key", F.lower("original"))
    return lookup(hits, names, ["key"], "inner", id_cols[0], row_weights(hits, ["key"])).select(
        *id_cols,
        F.lit("naming_advice").alias("type"),
        "original",
        F.col("template").cast("bigint").alias("template"),
        "sentence",
        F.concat(F.lit("naming hint for token "), "token", F.lit(", which stands for "), "original").alias("note"),
    )


def stub_speculation(docs: DataFrame, stubs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Guesses about names (``stubs``: one column ``original``) that were sent without a body.

    One row per document, stub and phrase; without any phrase, one row for the first sentence
    longer than 30 characters and 10 words that names the stub.
    """
    text = F.col(text_col)
    words = F.array_distinct(pieces_of(text, WORD))
    mentions = docs.select(*id_cols, F.explode(words).alias("original"))
    # Words are counted where they are found; only those that are stubs are written.
    counts = row_weights(mentions, ["original"])
    wanted = stubs.select("original").distinct()
    named = materialize(lookup(mentions, wanted, ["original"], "inner", id_cols[0], counts), "mentions")
    general = _phrases(docs, SPECULATION, False, id_cols, text_col)
    general = general.groupBy(*id_cols, "template").agg(F.min_by("sentence", "offset").alias("sentence"))
    about = (
        _phrases(docs, SPECULATION_ABOUT, True, id_cols, text_col)
        .groupBy(*id_cols, "template", F.lower("name").alias("key"))
        .agg(F.min_by("sentence", "offset").alias("sentence"))
        .withColumn("template", F.col("template") + len(SPECULATION))
    )
    phrased = named.join(general, id_cols).select(*id_cols, "original", "template", "sentence")
    phrased = phrased.unionByName(
        named.withColumn("key", F.lower("original"))
        .join(about, [*id_cols, "key"])
        .select(*id_cols, "original", "template", "sentence")
    )
    long_ones = F.filter(
        F.transform(F.split(text, r"\.", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
        lambda s: (F.length(s) > 30) & (F.size(F.split(s, r"\s+", -1)) > 10),
    )
    discussed = (
        docs.select(*id_cols, F.posexplode(long_ones).alias("nth", "sentence"))
        .select(*id_cols, "nth", "sentence", F.explode(F.array_distinct(pieces_of(F.col("sentence"), WORD))).alias("original"))
        .join(named, [*id_cols, "original"], "left_semi")
        .groupBy(*id_cols, "original")
        .agg(F.min_by("sentence", "nth").alias("sentence"))
        .join(phrased, [*id_cols, "original"], "left_anti")
        .withColumn("template", F.lit(0))
    )
    return phrased.unionByName(discussed.select(*phrased.columns)).select(
        *id_cols,
        F.lit("stub_speculation").alias("type"),
        "original",
        F.col("template").cast("bigint").alias("template"),
        "sentence",
        F.concat(
            F.when(F.col("template") > 0, F.lit("guess")).otherwise(F.lit("statement")),
            F.lit(" about "),
            "original",
            F.lit(", sent without a body"),
        ).alias("note"),
    )


# Marks of the footnotes.
MARK = {"naming_advice": "~~", "stub_speculation": "!!", "new_symbol": "++"}


def footnotes(docs: DataFrame, annotations: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """The text with its notes listed below, in a fixed order."""
    entries = [F.lit(x) for pair in MARK.items() for x in pair]
    ordered = annotations.groupBy(*id_cols).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("type"),
                    F.col("original"),
                    F.col("template"),
                    F.col("note"),
                    F.col("sentence"),
                )
            )
        ).alias("_notes")
    )
    lines = F.transform(
        "_notes",
        lambda n, i: F.concat(
            F.lit("["),
            F.coalesce(F.create_map(*entries)[n["type"]], F.lit("**")),
            F.lit(" "),
            (i + 1).cast("string"),
            F.lit("] "),
            n["note"],
            F.lit('\n   Context: "'),
            F.left(n["sentence"], F.lit(80)),
            F.lit('..."\n\n'),
        ),
    )
    others = [c for c in docs.columns if c != text_col]
    return docs.join(ordered, id_cols, "left").select(
        *others,
        F.when(F.col("_notes").isNull(), F.col(text_col))
        .otherwise(F.concat(F.col(text_col), F.lit("\n\n---\n**Annotations:**\n\n"), F.array_join(lines, "")))
        .alias(text_col),
        F.greatest(F.coalesce(F.size("_notes"), F.lit(0)), F.lit(0)).cast("bigint").alias("annotations"),
    )
