"""One masking job over files of several languages, under a policy and with one dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import fill
from cloakframe.functions.patterns import SCAN
from cloakframe.operators import audit, extract, literals, masking, policy
from cloakframe.operators.dictionary import build_dictionary, look_alikes, merge_dictionary
from cloakframe.operators.isolation import LANGUAGES, by_language, isolate_corpus
from cloakframe.plans.mask import Masked, restore
from cloakframe.session import COMPACT, materialize
from cloakframe.sources.dictionary_store import encrypt_dictionary

#: File types of running text, beside those of code.
PROSE_EXTENSIONS = ["txt", "md"]
SCANS = ["prose", "quoted", *LANGUAGES]


@dataclass
class MaskedCorpus(Masked):
    """``docs`` are the accepted files; ``decisions`` has a row per file: language, effective_level, status, reason."""

    decisions: DataFrame | None = None
    #: The settings that the tiers of the policy come to, one row.
    settings: DataFrame | None = None


def file_language(path: Column) -> Column:
    """Language by file type: code, ``prose`` for running text, null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(policy.language_of(path), F.when(extension.isin(PROSE_EXTENSIONS), "prose"))


def decide(files: DataFrame, policies: DataFrame, id_col: str, path_col: str, level_col: str) -> DataFrame:
    """(id, path, language, effective_level, status, reason): the policy's word, then the file type."""
    requests = files.select(id_col, F.col(path_col), F.col(level_col).cast("int").alias(level_col))
    gated = policy.policy_gate(requests, policies, id_col, path_col, level_col)
    language = file_language(F.col(path_col))
    unknown = (F.col("status") == "accepted") & language.isNull()
    kind = F.coalesce(F.regexp_extract(F.col(path_col), r"(\.[^./]*)$", 1), F.lit(""))
    return gated.select(
        id_col,
        path_col,
        language.alias("language"),
        "effective_level",
        F.when(unknown, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(unknown, F.concat(F.lit("unsupported file type '"), kind, F.lit("'"))).otherwise(F.col("reason")).alias("reason"),
    )


def mask_corpus(
    files: DataFrame,
    policies: DataFrame,
    dictionary: DataFrame | None = None,
    keep_comments: bool = False,
    section_col: str | None = None,
    hops: int | None = 1,
    bound_pattern: str = masking.BOUND,
    names_within: str = "word",
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    level_col: str = "level",
) -> MaskedCorpus:
    """Mask ``files`` (id, path, text, level and, if named, the section to isolate), each at its own level.

    The policy decides first; texts of rejected files are not read on. Every stage is one scan of all files that
    dispatches by a row's language, so names are numbered once, over all languages, and a name means the same token in
    every file. A stage of level 2, 3 or 4 takes the rows of that level and above.
    """
    ids = {"id_col": id_col, "text_col": text_col}
    text, language, level = F.col(text_col), F.col("language"), F.col("effective_level")
    decisions = materialize(decide(files, policies, id_col, path_col, level_col), "decisions")
    accepted = decisions.where("status = 'accepted'").select(id_col, "language", "effective_level")
    wanted = [text_col, *([section_col] if section_col else [])]
    docs = files.select(id_col, path_col, *wanted).join(accepted, id_col)

    comments = warnings = None
    if section_col:
        target = F.when((level >= 3) & language.isin(LANGUAGES), F.col(section_col))
        docs, warnings = isolate_corpus(docs.withColumn(section_col, target), section_col, "language", hops, **ids)
        docs, warnings = docs.drop(section_col), materialize(warnings, "warnings")
    if not keep_comments:
        bare = by_language(language, lambda name: masking.strip_comments(text, name), LANGUAGES)
        count = by_language(language, lambda name: masking.comment_count(text, name), LANGUAGES)
        docs = docs.withColumns({"comments_stripped": F.coalesce(count, F.lit(0).cast("bigint")), text_col: F.coalesce(bare, text)})
    scan = F.when((language == "prose") & (level >= 2), "quoted").otherwise(language)
    docs = materialize(docs.withColumn("_scan", scan), "accepted")

    binding = by_language(F.col("_scan"), lambda name: extract.binding_of(text, name), SCANS)
    symbols = materialize(docs.select(id_col, F.explode(binding).alias("s")).select(id_col, "s.*"), "bindings", COMPACT)
    foreign = materialize(look_alikes(docs, text_col), "look-alikes")
    if dictionary is None:
        dictionary = build_dictionary(symbols, foreign)
    else:
        dictionary = materialize(merge_dictionary(dictionary, symbols, foreign), "dictionary")
    resolved = masking.resolve(symbols, dictionary, id_col, stored=True).select(id_col, F.col("token").alias("value"), "at")

    def renamed(filled: Column) -> Column:
        return by_language(F.col("_scan"), lambda name: fill(text, SCAN[name], filled), SCANS)

    out = masking.substitute(docs, resolved, renamed, id_col, text_col, "symbols_scrubbed").drop("_scan")
    if keep_comments:
        found = by_language(language, lambda name: masking.numbered_comments(text, name), LANGUAGES)
        comments = out.select(id_col, F.explode(found).alias("c")).select(
            id_col, F.col("c.token").alias("token"), F.col("c.comment").alias("original")
        )
        comments = materialize(comments, "comments")
        held = by_language(language, lambda name: masking.placeholder_comments(text, name), LANGUAGES)
        out = out.withColumn(text_col, F.coalesce(held, text))
    out = materialize(out, "renamed", COMPACT)

    names = dictionary.where("kind NOT IN ('string', 'constant')").select(F.col("original").alias("name"))
    deep = out.where(level >= 2)
    known = literals.names_in_strings(deep, names, **ids, within=names_within)
    arrays = materialize(literals.literal_arrays(deep.join(known, id_col, "left"), known=F.col("known"), **ids), "literals")
    scrubbed = literals.scrubbed_symbols(arrays, id_col)
    dictionary = materialize(merge_dictionary(dictionary, scrubbed, foreign), "dictionary")
    out = literals.mask_literals(out, scrubbed, dictionary, **ids)

    bounds = materialize(masking.bounds(out.where(level >= 4), bound_pattern, **ids), "bounds")
    constants = bounds.select(id_col, "name", "kind", "scope").distinct()
    dictionary = materialize(merge_dictionary(dictionary, constants, foreign), "dictionary")
    out = materialize(masking.generalize_bounds(out, bounds, dictionary, bound_pattern, **ids), "masked")
    settings = policy.resolve_policy(policies).drop("banned_patterns")
    return MaskedCorpus(4, out, dictionary, symbols, comments, arrays, warnings, foreign, decisions, settings)


def restore_corpus(masked: MaskedCorpus, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The accepted files with their originals back."""
    return restore(masked, id_col, text_col)


def write_corpus(masked: MaskedCorpus, home: str, passphrase: str | None = None, path_col: str = "path", text_col: str = "text") -> None:
    """Write texts, dictionary and audit entries as the policy asks: encrypted if it says so, audited if it says so.

    An encrypted dictionary needs a passphrase; without one nothing is written.
    """
    settings = masked.settings.first()
    if settings["encrypt_maps"] and not passphrase:
        raise ValueError("the policy asks for an encrypted dictionary: give a passphrase")
    masked.docs.write.mode("errorifexists").parquet(f"{home}/docs")
    stored = encrypt_dictionary(masked.dictionary, passphrase) if settings["encrypt_maps"] else masked.dictionary
    stored.write.mode("errorifexists").parquet(f"{home}/dictionary")
    masked.decisions.write.mode("errorifexists").parquet(f"{home}/decisions")
    if settings["enforce_audit"]:
        entries = audit.hide_entries(masked.docs, F.col("effective_level"), path_col, text_col)
        entries.write.mode("errorifexists").parquet(f"{home}/audit")
