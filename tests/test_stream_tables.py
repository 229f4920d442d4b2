"""A table is a stream of its files, be it one file or a folder."""

import os

import pytest

from cloakframe.plans.catalog import QUERIES


@pytest.mark.parametrize("folder", [False, True])
def test_stream_reads_a_table_of_one_file_or_many(spark, tmp_path, folder):
    docs = spark.createDataFrame([(i, f"word{i} shared", "en", "s", 3) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    if folder:
        docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert os.path.isdir(f"{tmp_path}/documents.parquet") == folder
    out = QUERIES["stream_mask"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == [(i, 2) for i in range(6)]
