"""Every registered query against its SQL in DuckDB (or, without SQL, that it gives rows)."""

import os

import pytest
from compare import check, connect

import __spark_entry__ as entry

DATA = os.environ.get("KINFOLD_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    assert check(spark, duck, name, DATA) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
