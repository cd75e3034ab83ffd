"""Every query of the training-data operators that SQL can express, against that SQL."""

import os

import pytest
from compare import assert_same, connect

from tidemark.llm.queries import ORACLE, REGISTRY

FOLDER = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = connect(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert_same(REGISTRY[name](spark, FOLDER), duck, ORACLE[name])
