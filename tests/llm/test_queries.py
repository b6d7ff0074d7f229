"""Every training-data query against its SQL on the smallest tables; those without SQL for rows and columns."""

import pytest

from checks.compare import connect, difference
from tablescope.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert difference(spark, db, SF_DIR, name, QUERIES, ORACLES) is None
