import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cloakframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Make (doc_id, text) rows from strings."""
    return lambda *rows: spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, text string")


def column(df, name="text"):
    """Values of a column in the order of doc_id."""
    return [r[name] for r in df.orderBy("doc_id").select(name).collect()]
