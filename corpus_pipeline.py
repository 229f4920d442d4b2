"""The pipeline over ``documents``: each stage applies one operator to what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. Stages are written as Parquet and read again by ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, mixing, pii, quality, simhash
from cloakframe.llm.common import fresh, table
from cloakframe.llm.queries import QUALITY_META, THRESHOLD
from cloakframe.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the others go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", QUALITY_META)
    score = fresh(docs, "_score")
    return quality.with_score(docs, model, QUALITY_META, score).where(F.col(score) >= THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with <KIND> in place of each span of personal data."""
    return pii.mask_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents so that sources have their target shares; adds copy_no and shuffle_key."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: Scores and fingerprints have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
