import math

from pyspark.sql import functions as F

from replenish.operators import listings as L
from replenish.operators.scenarios import upsert
from replenish.params import PlanParams
from replenish.plans.model import SupplyModel
from tests.fixtures import mini_tables


def test_listings_order(spark):
    m = SupplyModel(spark, mini_tables(spark, with_bom=True), PlanParams())
    rl = L.risk_listing(m.health).collect()
    assert [r["stockout_risk"] for r in rl] == sorted(r["stockout_risk"] for r in rl)
    assert L.parents(m.bom).collect()[0][0] == "B"
    assert [r[0] for r in L.recipe(m.bom, "B").collect()] == ["C"]
    sl = L.scenario_listing(m.health).collect()
    assert all(a["recommended_order_qty"] >= b["recommended_order_qty"] for a, b in zip(sl, sl[1:]))
    assert L.plan_suppliers(m.base.where(F.col("recommended_order_qty") > 0)).first()[0] == "All suppliers"
    assert [r[0] for r in L.sku_list(m.health).collect()] == ["A", "B", "C", "D"]
    f = L.freight_listing(m.freight()).collect()
    assert all(a["cost_difference"] >= b["cost_difference"] for a, b in zip(f, f[1:]))
    assert not any(isinstance(r["days_of_cover"], float) and math.isinf(r["days_of_cover"]) for r in rl)


def test_scenario_upsert_replaces_same_name(spark):
    saved = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, v double")
    new = spark.createDataFrame([("b", 5.0), ("c", 3.0)], "name string, v double")
    assert sorted(tuple(r) for r in upsert(saved, new).collect()) == [("a", 1.0), ("b", 5.0), ("c", 3.0)]
