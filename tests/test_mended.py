"""Traps of earlier rounds: signs, delays, caps, empty inputs, fractional transfers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from replenish.operators import transfers as X
from replenish.params import PlanParams
from replenish.plans.model import SupplyModel
from replenish.sources import tpch
from tests.fixtures import mini_tables


def nested_loop(rows):
    """The greedy as first written: every deficit walks over all surpluses."""
    left = {id(r): r[3] for r in rows}
    out = []
    for a in rows:
        need = a[2]
        for b in rows:
            q = min(need, left[id(b)])
            if q >= 1:
                out.append((a[0], b[1], a[1], round(q), q * a[5]))
                need -= q
                left[id(b)] -= q
    return out


def test_walk_equals_nested_loop():
    rng = random.Random(4)
    for _ in range(400):
        rows = []
        for k in range(rng.randrange(1, 12)):
            amount = rng.choice([0.0, rng.random() * 3, rng.random() * 40, float(rng.randrange(5))])
            deficit = rng.random() < 0.5
            rows.append(("s", f"w{k}", amount if deficit else 0.0, 0.0 if deficit else amount, "p", 2.5))
        got = [(m[0], m[2], m[3], m[4], m[6]) for m in X._walk(rows)]
        assert got == nested_loop(rows)


def test_a_fractional_transfer_keeps_its_fraction(spark):
    base = spark.createDataFrame([("a", "p", "W1", 10.0, 5.0, 0.0, 1.4, 2.0), ("a", "p", "W2", 10.0, 4.0, 9.0, 1.0, 2.0)],
                                 "sku string, product string, warehouse string, unit_cost double, annual_revenue double, "
                                 "stock double, safety_stock double, reorder_point double")
    (t,) = X.exact_transfers(base).collect()
    assert (t.qty, t.saved_value, t.from_warehouse, t.to_warehouse) == (1, 14.0, "W2", "W1")


def test_negative_lines_are_clipped_one_by_one(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 5.0, 50.0, 0.0, day), (1, -3.0, -30.0, 0.0, day)],
                          "l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Lamp", 100.0)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    (r,) = tpch.sales_daily(tpch.Tables(spark, str(tmp_path))).collect()
    assert (r.qty, r.revenue, r.profit) == (5.0, 20.0, 18.0)


def test_scenario_delay_replaces_the_models(spark):
    from replenish.operators.scenarios import Scenario, scenario_rows
    p = PlanParams(lead_time_delay_days=5.0)
    m = SupplyModel(spark, mini_tables(spark), p)
    rows = scenario_rows(m.position(scaled=False), [Scenario("s", 1.0, 5.0), Scenario("t", 1.0, 2.0)], p)
    got = {(r["sc"]["name"], r["lead_time_days"]) for r in rows.select("sc", "lead_time_days").collect()}
    assert got == {("s", 14.0), ("t", 11.0)}


def test_no_returns_no_rates(spark):
    tables = mini_tables(spark)
    tables["returns"] = tables["returns"].limit(0)
    assert SupplyModel(spark, tables, PlanParams()).sku_returns().collect() == []


def test_alert_caps_come_from_the_parameters(spark):
    tables = mini_tables(spark)
    whole = SupplyModel(spark, tables, PlanParams()).result_tables()["alerts"]
    short = SupplyModel(spark, tables, PlanParams(stockout_alert_cap=0, dead_stock_alert_cap=0)).result_tables()["alerts"]
    groups = {r[0] for r in whole.select("type").collect()}
    assert "dead_stock" in groups and not {"dead_stock", "stockout_risk"} & {r[0] for r in short.select("type").collect()}


def test_capped_audit_keeps_the_first_rows(spark, tmp_path):
    m = SupplyModel(spark, mini_tables(spark), PlanParams())
    m.export_audit(str(tmp_path / "a"), cap=1)
    kept = spark.read.json(str(tmp_path / "a" / "inventory_health")).first()
    best = m.health.agg(F.max("annual_revenue")).first()[0]
    assert round(kept["annual_revenue"], 6) == round(best, 6)


def test_every_purchase_order_is_kept(spark):
    t = tpch.Tables(spark, "/root/testdata/sf0.001")
    assert tpch.purchase_orders(t).count() == t["lineitem"].count()


def test_stock_and_demand_without_a_full_join(spark):
    from replenish.operators.position import stock_demand
    inv = spark.createDataFrame([("a", "x", 1.0, 2.0, "S", "W", 1.0, "standard"), ("b", "y", 3.0, 2.0, "S", "W", 1.0, "standard")],
                                "sku string, product string, stock double, unit_cost double, supplier_id string, warehouse string, "
                                "min_order_qty double, storage_class string")
    stats = spark.createDataFrame([("a", "x", 5.0), ("c", "z", 6.0)], "sku string, product string, avg_daily_demand double").select(
        "*", *[F.lit(1.0).alias(c) for c in ("std_daily_demand", "recent_30d_qty", "annual_demand_qty", "annual_revenue", "annual_profit",
                                             "forecast_horizon_qty")])
    out = stock_demand(inv, stats)
    got = {r["sku"]: (r["stock"], r["warehouse"], r["avg_daily_demand"]) for r in out.collect()}
    assert got == {"a": (1.0, "W", 5.0), "b": (3.0, "W", 0.0), "c": (0.0, "Unassigned", 6.0)}
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
