"""Every query of the reference's own operators against its SQL twin, on the smallest tables."""

import math
import os

import pytest

from folioscope import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    if name not in plans.ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == wanted


def test_chrome_tables_are_dealt_by_page(spark, monkeypatch):
    """The line items of the chrome queries are dealt in parts that don't grow, which their joins by page take as they are."""
    from folioscope.plans import QUERIES, registry

    monkeypatch.setattr(registry, "ROWS_A_PART", 500)
    df = registry.dealt(registry.table(spark, "/root/testdata/sf0.001", "lineitem"), ("l_orderkey", "l_linenumber"))
    assert df.rdd.getNumPartitions() >= 10
    for name in ("chrome_keys_fixture", "chrome_regions_fixture", "content_extent_median", "raster_chrome_vote"):
        plan = QUERIES[f"{name}_on_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan
