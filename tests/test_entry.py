import __spark_entry__ as E

from conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "z_score" in df.columns and "prediction" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 36
    from greenscan.plans.queries import QUERIES
    assert set(QUERIES) <= set(q)
    for name in QUERIES:  # these names belong to the optional subpackage
        assert not name.startswith("op") and "pipeline" not in name


def test_queries_build_on_smoke_data(spark):
    q = E.queries()
    for name in ("detect_standard", "tokenize", "script_vote", "sweep_grid", "display_table"):
        assert q[name](spark, SF001).count() > 0
