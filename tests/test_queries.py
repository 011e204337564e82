"""Every registered query against its SQL check, over whole tables."""

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    if name in ORACLES:
        assert compare.difference(spark, SF_DIR, QUERIES[name], ORACLES[name], con) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["node_id", "owned"]


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
