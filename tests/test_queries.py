"""Every query of the core runs; where there is SQL, it gives the same rows."""

from __future__ import annotations

import pytest

from pagelens.plans import registry
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, name):
    df = registry.queries()[name](spark, data)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        df.count()
    else:
        same(df, connect(data), sql)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
