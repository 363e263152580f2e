"""Every query with checking SQL against that SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from check import rows_of  # noqa: E402

import __spark_entry__ as driver  # noqa: E402
from paperloom.plans.fixtures import TABLES  # noqa: E402

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want, expected = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert columns == expected
    assert got == want


def test_no_query_multiplies_rows(spark, sf):
    """No plan pairs all rows of two inputs."""
    for name in sorted(ORACLES):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_plans_stay_lean(spark, sf):
    """Meta features are hashed, and the merged cache reads the files it keeps once beside the cache's own reads."""
    plan = QUERIES["sc_meta_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    plan = QUERIES["cache_merge"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 0 and plan.count("LeftOuter") == 1


def test_entry(spark):
    assert driver.entry(spark).count() == 1500
