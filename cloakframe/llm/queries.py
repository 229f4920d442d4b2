"""The queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import (
    decontaminate,
    filter_audit,
    line_dedup,
    merkle,
    minhash,
    mixing,
    pii,
    quality,
    secrets,
    simhash,
    suffix_tree,
    toxicity,
    urls,
)
from cloakframe.llm.common import fold, table
from cloakframe.llm.oracles import ORACLES as ORACLES

THRESHOLD = 0.3
QUALITY_META = ["n_chars"]
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels.where(fold(5) != 0), "quality", QUALITY_META)
    return quality.with_score(docs.select("doc_id", "text", *QUALITY_META), model, QUALITY_META, "score").select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf, "documents")).select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(pii.BASE), 256).alias("base_sha256"),
        pii.listed(pii.KINDS).alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    grammar = toxicity.train(docs, labels.where(fold(4) != 2), "toxic")
    return toxicity.with_score(docs.select("doc_id", "text"), grammar, "score").select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op4_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf, "documents"))


def minhash_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The other half of operator 4: bands joined, pairs verified by Jaccard, classes of near copies at five words and 0.8."""
    return minhash.near_duplicate_classes(table(spark, sf, "documents"))


def op5_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), URL_RULES)


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model, rare = suffix_tree.fit(docs.where(fold(7) != 2))
    ids = [F.col("doc_id"), (fold(7) == 2).alias("held_out")]
    return suffix_tree.score_texts(docs, model, rare, ids)


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents"), path="source")


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf, "documents"), least_chars=40, least_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tampered = F.when(fold(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.manifest(docs, claimed=merkle.leaf_hash(text=tampered))
    checked = made.withColumn("check", merkle.folded("claimed", "witness"))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", "check.proof_sha256", F.col("check.root").alias("folded_root"), (F.col("check.root") == F.col("root")).alias("verified")
    )


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.interaction(table(spark, sf, "documents"), table(spark, sf, "labels"), part="lang")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_minhash": op4_minhash,
    "op5_urls": op5_urls,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_secrets": op10_secrets,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle": op12_merkle,
    "op13_filter_audit": op13_filter_audit,
    "minhash_classes": minhash_classes,
}
