"""Every query with SQL gives the SQL's rows on the smallest tables."""

import oracle
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    _, differences = oracle.compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert not differences


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
