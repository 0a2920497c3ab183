"""Hand-worked mini scenario: demand statistics, reorder maths, transfers,
BOM override (single level), returns."""

import math

import pytest
from pyspark.sql import functions as F

from replenish.params import PlanParams
from replenish.plans.model import SupplyModel
from tests.fixtures import mini_tables

P = PlanParams(as_of=None)


@pytest.fixture(scope="module")
def mini(spark):
    return SupplyModel(spark, mini_tables(spark), P)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_demand_stats_closed_form(mini):
    s = by_key(mini.stats(), "sku")
    assert s[("A",)]["avg_daily_demand"] == pytest.approx(30 / 90)
    assert s[("A",)]["std_daily_demand"] == pytest.approx(math.sqrt((500 - 900 / 90) / 89))
    assert s[("B",)]["avg_daily_demand"] == pytest.approx(1.0)
    assert s[("B",)]["std_daily_demand"] == pytest.approx(math.sqrt(90))
    assert s[("A",)]["recent_30d_qty"] == 30 and s[("B",)]["recent_30d_qty"] == 90


def test_closed_form_equals_dense_calendar(mini):
    cal = mini.dense_calendar().groupBy("sku").agg(F.avg("qty").alias("m"), F.stddev_samp("qty").alias("s"))
    st = by_key(mini.stats(), "sku")
    for r in cal.collect():
        assert r["m"] == pytest.approx(st[(r["sku"],)]["avg_daily_demand"], rel=1e-12)
        assert r["s"] == pytest.approx(st[(r["sku"],)]["std_daily_demand"], rel=1e-12)
    assert mini.dense_calendar().count() == 2 * 90


def test_reorder_math_and_risk(mini):
    b = by_key(mini.base, "sku", "warehouse")
    bb = b[("B", "W1")]
    ss = 1.65 * math.sqrt(90) * 3
    assert bb["safety_stock"] == pytest.approx(ss)
    assert bb["reorder_point"] == pytest.approx(9 + ss)
    assert bb["days_of_cover"] == pytest.approx(200)
    assert bb["stockout_risk"] == "Low" and bb["overstock_flag"]
    c = b[("C", "W1")]
    assert c["stockout_risk"] == "Dead-stock risk" and c["dead_stock_flag"] and c["overstock_flag"]
    assert math.isinf(c["days_of_cover"])
    a1 = b[("A", "W1")]
    assert a1["stockout_risk"] == "Critical"  # zero stock: cover 0
    assert a1["recommended_order_qty"] >= a1["shortage_qty"]


def test_transfers(mini):
    from replenish.operators.transfers import exact_transfers, whole_unit_transfers
    ex = exact_transfers(mini.base).collect()
    assert len(ex) == 1
    t = ex[0]
    ss = 1.65 * math.sqrt((500 - 10) / 89) * 3
    assert (t["sku"], t["from_warehouse"], t["to_warehouse"]) == ("A", "W2", "W1")
    assert t["qty"] == round(ss) and t["saved_value"] == pytest.approx(ss * 2)
    wu = whole_unit_transfers(mini.base).collect()
    assert len(wu) == 1 and wu[0]["qty"] == math.floor(ss)


def test_bom_single_level(spark):
    m = SupplyModel(spark, mini_tables(spark, with_bom=True), P)
    b = by_key(m.base, "sku")
    assert b[("C",)]["is_component"]
    assert b[("C",)]["avg_daily_demand"] == pytest.approx(2.0)
    assert b[("C",)]["forecast_horizon_qty"] == pytest.approx(60.0)
    assert b[("C",)]["annual_demand_qty"] == pytest.approx(730.0)
    assert b[("D",)]["avg_daily_demand"] == 0.0  # C's own pre-override demand is 0
    m2 = SupplyModel(spark, mini_tables(spark, with_bom=True), P.with_(bom_levels=2))
    assert by_key(m2.base, "sku")[("D",)]["avg_daily_demand"] == pytest.approx(2.0)


def test_returns(mini):
    from replenish.operators.returns import by_reason, totals
    t = totals(mini.returns).first()
    assert t["total_returns_qty"] == 5 and t["total_refund_value"] == pytest.approx(9.0)
    assert {r["reason"]: r["cases"] for r in by_reason(mini.returns).collect()} == {
        "quality_issue": 1, "changed_mind": 1, "damaged": 1}
    sr = mini.supplier_returns().collect()
    assert len(sr) == 1
    assert sr[0]["supplier_return_qty"] == 4 and sr[0]["supplier_quality_return_qty"] == 3


def test_multiplier_scales_mean_not_annual(spark):
    m = SupplyModel(spark, mini_tables(spark), P.with_(demand_multiplier=2.0))
    s = by_key(m.stats(), "sku")
    assert s[("B",)]["avg_daily_demand"] == pytest.approx(2.0)
    assert s[("B",)]["annual_demand_qty"] == pytest.approx(365.0)


def test_scenario_row_equals_single_run(spark, mini):
    from replenish.operators.scenarios import Scenario, scenario_rows, scenario_summary
    sc = [Scenario("base", 1.0, 0.0, 0.95), Scenario("x1.5", 1.5, 2.0, 0.99)]
    summ = by_key(scenario_summary(scenario_rows(mini.position(scaled=False), sc, P)), "name")
    single = SupplyModel(spark, mini_tables(spark), P.with_(demand_multiplier=1.5, lead_time_delay_days=2.0,
                                                             service_level=0.99))
    exp = single.base.agg(F.sum("inventory_value"), F.sum(F.when(F.col("recommended_order_qty") > 0,
                                                                  F.col("recommended_order_value")))).first()
    assert summ[("x1.5",)]["total_inventory_value"] == pytest.approx(exp[0])
    assert summ[("x1.5",)]["recommended_order_value"] == pytest.approx(exp[1] or 0.0)


def test_seeding_without_stock_and_suppliers(spark):
    t = mini_tables(spark)
    m = SupplyModel(spark, {"sales": t["sales"]}, P)
    inv = by_key(m.inventory, "sku")
    # A: last rows 10, 20, 7 -> mean 37/3 -> int(185) ; B: 90 -> 1350
    assert inv[("A",)]["stock"] == 185.0 and inv[("B",)]["stock"] == 1350.0
    assert inv[("A",)]["supplier_id"] == "UNKNOWN"
    sup = m.suppliers.collect()
    assert [(r["supplier_id"], r["lead_time_days"]) for r in sup] == [("UNKNOWN", 10.0)]
    assert m.base.count() == 2


def test_multi_warehouse_parent_counts_demand_per_row(spark):
    """Trap kept from the original: a parent stocked in two warehouses
    carries its full demand in each row, so a component gets it twice."""
    t = mini_tables(spark)
    t["bom"] = spark.createDataFrame([("A", "X", "Xcomp", 1.0)], "parent_sku string, component_sku string, "
                                                                  "component_name string, qty_required double")
    t["inventory"] = t["inventory"].unionByName(spark.createDataFrame(
        [("X", "Xcomp", 1.0, 1.0, "S1", "W1")], t["inventory"].schema))
    m = SupplyModel(spark, t, P)
    x = by_key(m.base, "sku")[("X",)]
    assert x["is_component"] and x["avg_daily_demand"] == pytest.approx(2 * 30 / 90)


def test_null_keys_become_defaults_not_dropped(spark):
    from replenish.operators.standardize import standardize_inventory, standardize_returns
    inv = spark.createDataFrame([(None, "thing", "3", None)], "sku string, product string, stock string, supplier_id string")
    r = standardize_inventory(inv).first()
    assert r["sku"] == "" and r["supplier_id"] == "UNKNOWN" and r["stock"] == 3.0
    ret = spark.createDataFrame([("2024-01-01", None, None, None)], "date string, sku string, qty string, reason string")
    rr = standardize_returns(ret).first()
    assert rr["sku"] == "UNKNOWN" and rr["reason"] == "Unassigned" and rr["return_qty"] == 1.0


def test_materialized_model_equals_lazy(spark):
    lazy = SupplyModel(spark, mini_tables(spark, with_bom=True), P)
    mat = SupplyModel(spark, mini_tables(spark, with_bom=True), P).materialize()
    cols = ["sku", "warehouse", "avg_daily_demand", "safety_stock", "recommended_order_qty", "stockout_risk",
            "is_component", "incoming_qty"]
    a = sorted(tuple(r) for r in lazy.base.select(*cols).collect())
    b = sorted(tuple(r) for r in mat.base.select(*cols).collect())
    assert a == b
    assert sorted(tuple(r) for r in lazy.health.select("sku", "warehouse", "abc_class").collect()) == \
        sorted(tuple(r) for r in mat.health.select("sku", "warehouse", "abc_class").collect())
    assert mat.history.count() == lazy.history.count() == 4
