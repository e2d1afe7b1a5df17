"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle
from claimloom.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, con, name):
    found = oracle.difference(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert found is None, found


def test_entry_is_lazy_and_small(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["category", "n"]
    assert frame.count() == 5
