"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from steadycast.plans import catalog

QUERIES, ORACLES = dict(catalog.QUERIES), dict(catalog.ORACLES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert difference(got, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0
