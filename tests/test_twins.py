"""Every query with an SQL twin gives the twin's rows (some thresholds leave none at this scale)."""

import pytest

import __spark_entry__ as entry

from .conftest import SF
from .oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_contract():
    queries = entry.queries()
    assert set(SQL) <= set(queries) and len(queries) > 160


def test_flagship(spark):
    assert entry.entry(spark).columns == ["level", "district", "kind", "month", "mean_dlog", "pairs"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    equal, note, _ = compare(spark, duck, name, entry.queries()[name], SQL[name], SF, allow_empty=True)
    assert equal, note
