"""Physical-plan checks: no Python evaluation in the core planning path,
the window filter reaches the Parquet scan, ABC avoids a single-task window."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_plan_has_no_python_udf(spark):
    from replenish.plans.catalog import QUERIES
    for name in ("reorder_plan", "supplier_risk", "kpis", "freight_modes", "cost_curves", "demand_spikes",
                 "transfers_whole_units", "alerts", "scenario_grid"):
        p = _plan(QUERIES[name](spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p, name


def test_window_filter_pushed_to_scan(spark):
    from replenish.plans.catalog import model
    m = model(spark, SF)
    p = m.daily._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p


def test_abc_uses_range_partitioned_scan(spark):
    from replenish.plans.catalog import model
    p = _plan(model(spark, SF).health)
    assert "SinglePartition" not in p.split("Subquery")[0]


def test_the_plan_ranks_narrow_rows(spark, monkeypatch):
    """Rows with nothing to order pass the ranking as their keys alone, the others with the plan's columns."""
    from fixtures import mini_tables
    from replenish.operators import reorder as R
    from replenish.plans.model import SupplyModel
    ranked, running = [], R.running
    monkeypatch.setattr(R, "running", lambda df, *a, **k: ranked.append(df) or running(df, *a, **k))
    m = SupplyModel(spark, mini_tables(spark), seed=False)
    got = m.reorder_plan()
    assert set(ranked[0].columns) == {*R.TIE, "annual_revenue", "_plan"}
    orders = m.base.where("recommended_order_qty > 0").count()
    assert 0 < orders < m.base.count() == ranked[0].count() and ranked[0].where("_plan is not null").count() == orders
    whole = R.reorder_plan(m.health)
    assert got.columns == whole.columns and got.schema.simpleString() == whole.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    # classes that are there already are used
    assert sorted(map(str, m.reorder_plan().collect())) == sorted(map(str, whole.collect())) and len(ranked) == 2


def test_seeding_reads_the_sales_once(spark, tmpdir_path):
    from replenish.operators.demand import seed_inventory
    path = f"{tmpdir_path}/sales"
    spark.sql("SELECT 'A' AS sku, 'p' AS product, DATE'2024-01-01' AS date, 2.0D AS qty, IF(id < 2, NULL, 3.0D) AS cost FROM range(4)").write.parquet(path)
    seeded = seed_inventory(spark.read.parquet(path))
    plan = seeded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert [(r.sku, r.stock, r.unit_cost) for r in seeded.collect()] == [("A", 30.0, 3.0)]
