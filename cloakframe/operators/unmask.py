"""Restoring text: tokens, comment placeholders, reply zones, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import fill, fill_known, gaps_of, groups, in_row_key, let, pieces_of, runs, unknown_slots
from cloakframe.functions.patterns import IS_TOKEN, PLACEHOLDER, WORD
from cloakframe.operators.dictionary import by_token, tokens_in
from cloakframe.operators.lookups import frequent_entries, heavy_keys, in_row_table, lookup, row_weights, with_table
from cloakframe.operators.masking import substitute
from cloakframe.session import COMPACT, materialize


def token_slots(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(ids, n, slots): distinct tokens of each text with their places among its words; ``n`` is 0."""
    found = groups(pieces_of(F.col(text_col), WORD), lambda w: w.rlike(IS_TOKEN))
    return docs.select(*id_cols, F.lit(0).alias("n"), found.alias("slots"))


def unmask(
    docs: DataFrame,
    dictionary: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    map_col: str | None = None,
    mark_unknown: bool = True,
) -> DataFrame:
    """Replace tokens by originals; unknown ones get ``NEW_`` in front.

    Adds ``n_restored`` (distinct tokens) and ``unknown`` (sorted, listed before they are marked).
    With ``map_col`` every document is restored from the dictionary of that name. If the dictionary has ``n_docs``, frequent
    tokens are looked up inside the row of the text and never shuffled. Of the others, those met in a large share of all
    texts are spread over several tasks; to count them, the places of the tokens are written once, which also saves a
    second scan of the texts.
    """
    keys = ["token"] if map_col is None else [map_col, "token"]
    kept = [id_col] if map_col is None else [id_col, map_col]
    group = None if map_col is None else F.col(map_col)
    text, table = F.col(text_col), None
    if "n_docs" in dictionary.columns:
        key = F.col("token") if group is None else in_row_key(group, F.col("token"))
        table = in_row_table(frequent_entries(dictionary.where(F.col("token").rlike(IS_TOKEN)), key, F.col("original")))
    if table is None:
        found = token_slots(docs, kept, text_col)
    else:
        slots = unknown_slots(pieces_of(text, WORD), IS_TOKEN, F.col("_table"), group)
        found = with_table(docs, table).select(*kept, slots.alias("s")).select(*kept, "s.n", "s.slots")
    found = materialize(found, "tokens", COMPACT)
    others = found.select(*kept, F.explode("slots").alias("s")).select(*kept, F.col("s.key").alias("token"), F.col("s.at").alias("at"))
    entries = dictionary.select(*keys, "original")
    resolved = lookup(others, entries, keys, "left", spread=id_col, weights=heavy_keys(others, keys))
    parts = resolved.select(
        id_col,
        "original",
        "at",
        F.when(F.col("original").isNull(), F.col("token")).alias("unknown"),
        F.lit(None).cast("bigint").alias("n"),
    )
    if table is not None:
        none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in ("original", "at", "unknown")]
        parts = parts.unionByName(found.where("n > 0").select(id_col, F.col("n").cast("bigint").alias("n"), *none))
    # What an unknown token becomes is put together behind the shuffle.
    value = F.coalesce(F.col("original"), F.concat(F.lit("NEW_"), F.col("unknown")) if mark_unknown else F.col("unknown"))
    per_doc = parts.repartition(id_col).groupBy(id_col).agg(
        F.collect_list(F.when(F.col("n").isNull(), F.struct(value.alias("value"), F.col("at")))).alias("_filled"),
        (F.count("original") + F.coalesce(F.sum("n"), F.lit(0))).alias("n_restored"),
        F.sort_array(F.collect_set("unknown")).alias("unknown"),
    )
    joined, filled = docs.join(per_doc, id_col, "left"), F.col("_filled")
    if table is None:
        done = fill(text, WORD, filled)
    else:
        joined = with_table(joined, table)
        done = F.when(F.col(id_col).isNull(), text).otherwise(fill_known(text, WORD, filled, F.col("_table"), group))
    return joined.select(
        *[c for c in docs.columns if c != text_col],
        done.alias(text_col),
        F.coalesce("n_restored", F.lit(0)).cast("bigint").alias("n_restored"),
        F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"),
    )


def unknown_tokens(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, n) for tokens that no dictionary entry explains."""
    return by_token(tokens_in(docs, id_col, text_col), dictionary.select("token"), "left_anti")


# Only where a placeholder or its wrapping can start are the forms tried.
_FORMS = "|".join(
    [
        rf'"""{PLACEHOLDER}"""',
        rf"'''{PLACEHOLDER}'''",
        rf"/\* {PLACEHOLDER} \*/",
        rf"// {PLACEHOLDER}",
        rf"<!-- {PLACEHOLDER} -->",
        rf"# {PLACEHOLDER}",
        PLACEHOLDER,
    ]
)
_WRAPPED = rf"(?=[\"'/<#\[])(?:{_FORMS})"


def restore_comments(docs: DataFrame, store: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put comments back in place of their placeholders, wrapped or bare."""
    found = docs.select(id_col, F.explode(groups(pieces_of(F.col(text_col), _WRAPPED))).alias("s")).select(
        id_col, F.regexp_extract("s.key", f"({PLACEHOLDER})", 1).alias("token"), F.col("s.at").alias("at")
    )
    resolved = found.join(store.select(id_col, "token", F.col("original").alias("value")), [id_col, "token"])
    return substitute(docs, resolved.select(id_col, "value", "at"), _WRAPPED, id_col, text_col)


# --- replies ------------------------------------------------------------------------------

FENCED = r"```[A-Za-z0-9_]*\n[\s\S]*?```"
INLINE = r"`[^`]+`"
ZONES = "array<struct<zone_type:string,language:string,content:string>>"


def zones_of(text: Column) -> Column:
    """array<struct<zone_type, language, content>> in reading order; no empty zones of prose."""

    def zone(kind: str, language: Column, content: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("zone_type"), language.alias("language"), content.alias("content")
        )

    def prose(part: Column) -> Column:
        inline = F.filter(
            F.flatten(
                F.zip_with(
                    gaps_of(part, INLINE),
                    pieces_of(part, INLINE),
                    lambda g, p: F.array(
                        zone("prose", F.lit(""), g),
                        F.when(p.isNotNull(), zone("inline_code", F.lit(""), F.btrim(p, F.lit("`")))),
                    ),
                )
            ),
            lambda z: z.isNotNull() & (z["content"] != ""),
        )
        return inline.cast(ZONES)

    def fenced(piece: Column) -> Column:
        return F.array(
            zone(
                "code_block",
                F.regexp_extract(piece, r"^```([A-Za-z0-9_]*)\n", 1),
                F.regexp_extract(piece, r"^```[A-Za-z0-9_]*\n([\s\S]*?)```$", 1),
            )
        ).cast(ZONES)

    return F.flatten(
        F.zip_with(
            gaps_of(text, FENCED),
            pieces_of(text, FENCED),
            lambda g, p: F.concat(prose(g), F.when(p.isNotNull(), fenced(p)).otherwise(F.array().cast(ZONES))),
        )
    )


def zones(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    return docs.select(*id_cols, F.posexplode(zones_of(F.col(text_col))).alias("zone", "z")).select(
        *id_cols, F.col("zone").cast("bigint").alias("zone"), "z.*"
    )


_HITS = "array<struct<zone:int,at:int,token:string,original:string>>"

# A token in prose counts only before a possessive, punctuation, space or the end.
_PROSE_NEXT = r"^(?:'s|[-/.,;:!?\s)]|\z)"


def _zone_slots(zone_list: Column) -> Column:
    """array<struct<token, at array<struct<zone, at>>>> over all zones of a reply."""

    def in_zone(z: Column, n: Column) -> Column:
        def pick(gaps: Column, words: Column) -> Column:
            return F.filter(
                F.transform(
                    words,
                    lambda w, i: F.struct(w.alias("token"), n.alias("zone"), i.alias("at")),
                ),
                lambda s: s["token"].rlike(IS_TOKEN)
                & (
                    (z["zone_type"] != "prose")
                    | F.concat(F.get(gaps, s["at"] + 1), F.coalesce(F.get(words, s["at"] + 1), F.lit(""))).rlike(_PROSE_NEXT)
                ),
            )

        return let(
            gaps_of(z["content"], WORD),
            lambda gaps: let(pieces_of(z["content"], WORD), lambda words: pick(gaps, words)),
        )

    found = F.sort_array(F.flatten(F.transform(zone_list, in_zone)))
    return F.transform(
        runs(found, "token"),
        lambda run: F.struct(
            F.get(run, F.lit(0))["token"].alias("token"),
            F.transform(run, lambda s: F.struct(s["zone"].alias("zone"), s["at"].alias("at"))).alias("at"),
        ),
    )


def unmask_replies(docs: DataFrame, dictionary: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Restore replies zone by zone.

    Adds to the ids: explanation (the whole reply restored), code (its code blocks, one blank line
    between them), n_restored, new_symbols and new_dependencies.
    """
    replies = docs.withColumn("_zones", zones_of(F.col(text_col)))
    found = materialize(
        replies.select(*id_cols, F.explode(_zone_slots(F.col("_zones"))).alias("s")).select(
            *id_cols, F.col("s.token").alias("token"), F.col("s.at").alias("at")
        ),
        "reply-tokens",
    )
    resolved = lookup(
        found,
        dictionary.select("token", "original"),
        ["token"],
        "left",
        spread=id_cols[0],
        weights=row_weights(found, ["token"]),
    )
    per_reply = resolved.groupBy(*id_cols).agg(
        F.collect_list(F.struct("token", "original", "at")).alias("_found")
    )

    def restored(z: Column, mine: Column) -> Column:
        """The zone with known tokens restored; in code, unknown ones are marked."""
        unknown = F.when(z["zone_type"] == "code_block", F.concat(F.lit("NEW_"), mine["token"])).otherwise(mine["token"])
        return F.struct(F.coalesce(mine["original"], unknown).alias("value"), F.array(mine["at"]).alias("at"))

    def by_zone(found_: Column, zone_list: Column) -> Column:
        """For each zone the tokens in it: one sort of the tokens and of a mark in front of each zone."""
        hits = F.flatten(
            F.transform(
                found_,
                lambda f: F.transform(
                    f["at"],
                    lambda a: F.struct(
                        a["zone"].alias("zone"), a["at"].alias("at"), f["token"].alias("token"), f["original"].alias("original")
                    ),
                ),
            )
        ).cast(_HITS)
        marks = F.transform(
            zone_list,
            lambda z, n: F.struct(
                n.alias("zone"), F.lit(-1).alias("at"), F.lit(None).alias("token"), F.lit(None).alias("original")
            ),
        ).cast(_HITS)
        return runs(F.sort_array(F.concat(marks, hits)), "zone")

    def wrap(z: Column) -> Column:
        return (
            F.when(
                z["zone_type"] == "code_block",
                F.concat(F.lit("```"), z["language"], F.lit("\n"), z["content"], F.lit("\n```")),
            )
            .when(z["zone_type"] == "inline_code", F.concat(F.lit("`"), z["content"], F.lit("`")))
            .otherwise(z["content"])
        )

    def code_of(zone_list: Column) -> Column:
        return F.transform(
            F.filter(zone_list, lambda z: z["zone_type"] == "code_block"), lambda z: z["content"]
        )

    empty = F.array().cast("array<struct<token:string,original:string,at:array<struct<zone:int,at:int>>>>")
    done = (
        replies.join(per_reply, id_cols, "left")
        .withColumn("_found", F.coalesce("_found", empty))
        .withColumn(
            "_restored",
            F.zip_with(
                F.col("_zones"),
                by_zone(F.col("_found"), F.col("_zones")),
                lambda z, run: F.struct(
                    z["zone_type"].alias("zone_type"),
                    z["language"].alias("language"),
                    fill(
                        z["content"], WORD, F.transform(F.slice(run, F.lit(2), F.size(run)), lambda h: restored(z, h))
                    ).alias("content"),
                ),
            ),
        )
    )
    in_code = let(
        F.col("_zones"),
        lambda zone_list: F.filter(
            F.col("_found"),
            lambda f: F.exists(f["at"], lambda a: F.get(zone_list, a["zone"])["zone_type"] == "code_block"),
        ),
    )
    return done.select(
        *id_cols,
        F.array_join(F.transform("_restored", wrap), "").alias("explanation"),
        F.array_join(code_of(F.col("_restored")), "\n\n").alias("code"),
        F.size(F.filter("_found", lambda f: f["original"].isNotNull())).cast("bigint").alias("n_restored"),
        F.array_sort(
            F.transform(F.filter(in_code, lambda f: f["original"].isNull()), lambda f: f["token"])
        ).alias("new_symbols"),
        dependencies_of(F.array_join(code_of(F.col("_zones")), "\n")).alias("new_dependencies"),
    )


DEPENDENCY = r"^(?:#include|import |from )"


def dependencies_of(text: Column, pattern: str = DEPENDENCY) -> Column:
    """Trimmed lines that bring in a header or a module, in reading order."""
    return F.filter(
        F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")),
        lambda line: line.rlike(pattern),
    )

