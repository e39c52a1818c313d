"""Every registered query with oracle SQL gives the same rows as DuckDB."""
import pytest

import __spark_entry__ as E
from tools.check_oracle import rows_of

from conftest import SF_SMALL

KEYS = sorted(E.oracle_sql())


def test_every_query_has_a_callable():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[key])
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert rows_of(sdf.columns, s_rows) == rows_of(rel.columns, d_rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["query_id", "rank", "business_id"]
