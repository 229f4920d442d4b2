"""Every query with its SQL on the smallest tables."""

import os

import pytest

from cloakframe.plans.catalog import QUERIES
from cloakframe.plans.oracles import ORACLES
from tools.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR).startswith("equal")


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
