"""Every registered query against its SQL statement on the same tables."""

import pytest

import __spark_entry__ as contract
from dialtrace.registry import ORACLE, QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def tables(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_check():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    assert difference(QUERIES[name](spark, sf_dir), tables, ORACLE[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
