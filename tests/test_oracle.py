"""Every registered query against its SQL counterpart on the same tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as spark_entry
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name not in ORACLE:
        assert result.count() > 0
        return
    found = differences(result, con, ORACLE[name])
    assert not found, "\n".join(s[:600] for s in found)
