"""Corpus queries against their SQL on the smallest scale."""

import pytest
from oracle import compare, connect

from faultline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    problem, _ = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLE[name])
    assert not problem
