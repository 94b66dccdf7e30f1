"""Every registered query against its SQL on the smallest scale."""

import pytest
from oracle import compare, connect

from faultline.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, sf_dir, name):
    problem, _ = compare(spark, con, sf_dir, QUERIES[name], ORACLE[name])
    assert not problem


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
