"""Every registered query against its oracle at the smallest scale."""

import pytest

from checks.compare import compare, connect
from tests.conftest import SF

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "spend"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert compare(duck, entry.oracle_sql()[name], df) is None
    else:
        assert df.count() > 0
