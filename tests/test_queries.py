"""Every query that has SQL against DuckDB, and every other one for rows."""

import pytest
from compare import same

from pulseforge.plans.oracles import ORACLES
from pulseforge.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
