import pytest
from helpers import assert_same, connect

from lodestone.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, con, sf_dir):
    assert_same(spark, con, sf_dir, catalog.queries()[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(ORACLES)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["severity", "kept", "omitted"]
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
