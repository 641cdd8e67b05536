"""Every registered query of the rule operators against DuckDB on the smallest tables."""

import os

import pytest

from rulemill import queries

from .oracle import differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) is None


def test_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
