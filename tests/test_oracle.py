"""Every core query with SQL gives the SQL's rows on the smallest tables; every other one runs."""

import pytest

from plenora.plans import registry
from tests.conftest import DATA
from tests.oracle import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(e.queries())
