"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_entry(spark):
    row = contract.entry(spark).collect()[0]
    assert 0 <= row.score <= 100 and row.grade


def test_every_key_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert difference(spark, db, SF_DIR, name) is None
