import pytest

import oracle
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_each_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_its_sql(spark, sf_dir, con, name):
    oracle.same(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name])
