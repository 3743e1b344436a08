"""Every registered query: against its SQL where there is one, else that it yields rows."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql_without_cross_join(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows, differences = compare(df, db, ORACLES[name])
    assert rows and not differences


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_yields_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["group_year_mean", "entity_mean", "label_counts"])
def test_scan_reads_only_the_needed_columns(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    panel_scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "entity" in line)
    assert "ReadSchema" in panel_scan and "gdppc:double,industry" not in panel_scan
    assert sum(f"{c}:double" in panel_scan for c in ("withdrawals", "productivity", "industry", "population")) <= 2


def test_sorted_by_group_and_year(spark, db):
    """In order as SQL gives it, not only as a set."""
    mine = [(r.income_group, r.year) for r in QUERIES["weighted_overall_mean"](spark, SF).collect()]
    assert len(mine) > 5 and mine == [r[:2] for r in db.execute(ORACLES["weighted_overall_mean"]).fetchall()]
