"""Isolation of one section per document, with stubs for what it calls anywhere in the corpus.

Sections, calls and definitions are tables. A call is resolved in its own document first, else to the first
definition of that name in the corpus. What a wanted section reaches is found by frontier rounds over the resolved
calls: one round per hop, each a join by (document, name) and an anti-join with what was reached before. Only ids and names
travel; signatures are joined to what was reached at the end, and a text meets its section and its stubs in one join by id.

A name that a large share of all documents calls or reaches is spread over several partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.extract import called_names
from cloakframe.operators.lookups import lookup, row_weights
from cloakframe.operators.sections import isolated_text, sections_of, stub_text
from cloakframe.session import materialize

LANGUAGES = ["python", "cpp"]


def by_language(language: Column, make, languages: list[str]) -> Column:
    """``make(name)`` of the language that a row is in; null for others. One scan serves all languages."""
    choice = F.lit(None)
    for name in reversed(languages):
        choice = F.when(language == name, make(name)).otherwise(choice)
    return choice


def definitions(docs: DataFrame, language_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, language, start_line, signature, body): the first section of each name in each document."""
    found = by_language(F.col(language_col), lambda name: sections_of(F.col(text_col), name), LANGUAGES)
    rows = docs.select(F.col(id_col).alias("id"), F.col(language_col).alias("language"), F.explode(found).alias("s"))
    first = rows.groupBy("id", "language", "s.name").agg(
        F.min_by(F.struct("s.start_line", "s.signature", "s.body"), "s.start_line").alias("s")
    )
    return first.select("id", "name", "language", "s.start_line", "s.signature", "s.body")


def resolved_calls(defs: DataFrame) -> DataFrame:
    """(id, name, to_id, to_name): calls between definitions of one language, in the same document or another one."""
    calls = defs.select("id", "language", "name", F.explode(called_names(F.col("body"))).alias("to_name")).where("name <> to_name")
    own_names = defs.select("id", "language", F.col("name").alias("to_name"))
    key = ["id", "language", "to_name"]
    own = calls.join(own_names, key, "left_semi").withColumn("to_id", F.col("id"))
    away = materialize(calls.join(own_names, key, "left_anti"), "calls-away")
    homes = defs.groupBy("language", F.col("name").alias("to_name")).agg(F.min("id").alias("to_id"))
    far = ["language", "to_name"]
    found = lookup(away, homes, far, "inner", "id", row_weights(away, far))
    columns = ["id", "name", "to_id", "to_name"]
    return own.select(*columns).unionByName(found.select(*columns))


def reached_sections(wanted: DataFrame, calls: DataFrame, hops: int | None = 1) -> DataFrame:
    """(request, id, name): sections that the ``wanted`` ones (request, id, name) call within ``hops``, or at any distance."""
    seen = frontier = materialize(wanted.select("request", "id", "name").distinct(), "frontier")
    edges = calls.select("id", "name", "to_id", "to_name")
    rounds = 0
    while hops is None or rounds < hops:
        rounds += 1
        met = lookup(frontier, edges, ["id", "name"], "inner", "request", row_weights(frontier, ["id", "name"]))
        met = met.select("request", F.col("to_id").alias("id"), F.col("to_name").alias("name")).distinct()
        frontier = materialize(met.join(seen, ["request", "id", "name"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(wanted, ["request", "id", "name"], "left_anti")


def isolate_corpus(
    docs: DataFrame,
    target_col: str,
    language_col: str,
    hops: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, warnings): the text of each document cut to the section that ``target_col`` names.

    Documents without a target stay whole, and so do those whose target is missing, with a warning. ``isolated`` tells
    which were cut. ``hops`` is how far calls are followed for stubs; None: to the end.
    """
    defs = materialize(definitions(docs, language_col, id_col, text_col), "definitions")
    calls = materialize(resolved_calls(defs), "calls")
    asked = docs.where(F.col(target_col).isNotNull()).select(
        F.col(id_col).alias("request"), F.col(id_col).alias("id"), F.col(target_col).alias("name")
    )
    hits = asked.join(defs.select("id", "name"), ["id", "name"], "left_semi")
    reached = materialize(reached_sections(hits, calls, hops), "reached")
    stub = by_language(F.col("language"), lambda name: stub_text(F.col("signature"), name), LANGUAGES)
    stubs = defs.select("id", "name", "start_line", stub.alias("stub"))
    told = lookup(reached, stubs, ["id", "name"], "inner", "request", row_weights(reached, ["id", "name"]))
    # Those of the same document first, then by document, each in reading order.
    told = told.groupBy("request").agg(
        F.array_sort(F.collect_list(F.struct((F.col("id") != F.col("request")).alias("away"), "id", "start_line", "stub"))).alias("_stubs")
    )
    sections = defs.select(
        F.col("id").alias("_id"), F.col("name").alias("_target"), F.struct("name", "start_line", "body").alias("_section")
    )
    met = (
        docs.join(sections, (F.col(id_col) == F.col("_id")) & (F.col(target_col) == F.col("_target")), "left")
        .drop("_id", "_target")
        .join(told.withColumnRenamed("request", "_request"), F.col(id_col) == F.col("_request"), "left")
        .drop("_request")
    )
    listed = F.coalesce(F.transform("_stubs", lambda s: s["stub"]), F.array().cast("array<string>"))
    cut = by_language(F.col(language_col), lambda name: isolated_text(F.col(text_col), F.col("_section"), listed, name), LANGUAGES)
    found = F.col("_section").isNotNull()
    others = [c for c in docs.columns if c != text_col]
    out = met.select(*others, F.when(found, cut).otherwise(F.col(text_col)).alias(text_col), found.alias("isolated"))
    missed = asked.join(hits, ["request", "id", "name"], "left_anti").select(
        F.col("request").alias(id_col),
        F.lit("isolation_missed").alias("type"),
        F.col("name").alias("symbol"),
        F.lit("section not found, whole text kept").alias("detail"),
    )
    return out, missed
