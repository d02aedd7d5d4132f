import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["lang", "source", "total", "documented", "coverage_pct"]
