"""Every registered query runs; those with an oracle match it (smallest data)."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    rows, ok, why = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert rows >= 0 and ok in (True, None), why
