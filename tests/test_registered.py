"""Every registered query of the review operators beside its SQL on the given tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from voxtally.plans.driver_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, SF) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
