"""Intermediate tables and their removal."""

import glob
import os

import pytest

from cloakframe import session
from cloakframe.plans import catalog


def test_intermediates_are_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", {})
    kept = session.materialize(spark.range(5).toDF("x"), "kept-for-a-while")
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
    assert glob.glob(f"{folder}/*.parquet") and kept.count() == 5
    assert session.drop_intermediates(spark) == 1
    assert not os.path.exists(folder) and session.drop_intermediates(spark) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_start_anew_after_a_removal(spark):
    sf = "/root/testdata/sf0.001"
    before = catalog.dict_lookup(spark, sf).count()
    session.drop_intermediates(spark)
    assert catalog.dict_lookup(spark, sf).count() == before > 0
