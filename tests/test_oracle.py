"""Every registered query against its SQL, on the smallest tables."""

import os

import oracle
import pytest

from __spark_entry__ import entry
from vigilog.plans.queries import ORACLES, QUERIES

FOLDER = os.environ.get("VIGILOG_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) == ""
