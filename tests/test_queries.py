"""Every registered query against its SQL, on the smallest tables, and the entry module itself."""

import os

import pytest

import __spark_entry__ as entry_module
from checks.compare import compare, oracle_connection
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry_module.queries().keys()
    assert QUERIES.keys() <= entry_module.oracle_sql().keys()
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "language_tag" in df.columns
