"""Every registered query against its SQL oracle."""

import os

import pytest
from compare import assert_same, connect

from __spark_entry__ import entry, oracle_sql, queries
from oracle import ORACLE
from tidemark.queries import REGISTRY

FOLDER = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = connect(FOLDER)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(ORACLE) == set(REGISTRY)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    assert_same(queries()[name](spark, FOLDER), duck, oracle_sql()[name])


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["category", "category_revenue", "category_quantity"]
    assert result.count() > 0
