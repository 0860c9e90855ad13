"""Every registered query against its DuckDB oracle on the smallest tables
(SURVEY section 5, item 2); the full-size run is tests/oracle_compare.py."""
import pytest

import __spark_entry__ as E
from oracle_compare import canon, duck

from conftest import SF001

QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.fixture(scope="module")
def oracle(spark):  # built with an active session, so ICU-based entries are included
    return E.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, oracle, name):
    if name not in oracle:
        pytest.skip("rows-only query (no SQL form)")
    sdf = QUERIES[name](spark, SF001)
    s_rows, s_cols = [tuple(r) for r in sdf.collect()], sdf.columns
    rel = con.sql(oracle[name])
    d_cols, d_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert canon(s_rows, s_cols) == canon(d_rows, d_cols)
