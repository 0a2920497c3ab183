"""Hand-worked values of the invented shop (no sales file, no BOM)."""

import math

import pytest
from pyspark.sql import functions as F

from replenish.params import PlanParams
from replenish.sources.files import load_dir
from replenish.sources.workspace import Workspace
from tests.fixtures import write_sample_dir


@pytest.fixture(scope="module")
def sample_model(spark):
    import tempfile
    d = write_sample_dir(tempfile.mkdtemp(prefix="sample-"))
    ws = Workspace(spark).update(load_dir(spark, d))
    return ws, ws.model(PlanParams())


def test_roles_detected(sample_model):
    ws, _ = sample_model
    assert ws.roles() == {"inventory": "stock_levels", "suppliers": "vendors", "purchase_orders": "purchase_orders",
                          "returns": "return_log", "sales": None, "bom": None}
    ws2 = Workspace(ws.spark).update(ws.tables).set_role("sales", "return_log")
    assert ws2.roles()["sales"] == "return_log"


def test_inventory_value_and_risk(sample_model):
    _, m = sample_model
    rows = {r["sku"]: r for r in m.base.collect()}
    # 10 x 2.5 + 0 + 7 x 1.1 + 30 x 0.75 + 3 x 12
    assert len(rows) == 5 and round(sum(r["inventory_value"] for r in rows.values()), 2) == 91.2
    assert {k: r["stockout_risk"] for k, r in rows.items()} == {
        "N-1": "Dead-stock risk", "N-2": "Low", "N-3": "Dead-stock risk", "N-4": "Dead-stock risk", "N-5": "Dead-stock risk"}
    assert all(math.isinf(r["days_of_cover"]) for r in rows.values())
    assert all(r["recommended_order_qty"] == 0 for r in rows.values())
    assert all(r["dead_stock_flag"] == r["overstock_flag"] for r in rows.values())


def test_incoming_excludes_received(sample_model):
    _, m = sample_model
    inc = {r[0]: r[1] for r in m.base.where(F.col("incoming_qty") > 0).select("sku", "incoming_qty").collect()}
    assert inc == {"N-1": 20, "N-2": 15, "N-3": 5}


def test_abc_all_c(sample_model):
    _, m = sample_model
    assert {r[0] for r in m.health.select("abc_class").distinct().collect()} == {"C"}


def test_supplier_scores(sample_model):
    """(1 - on time) x 45 + defects x 250 + lead / 60 x 25 + spread / 20 x 15"""
    _, m = sample_model
    got = {r["supplier_id"]: (r["supplier_risk_score"], r["risk_level"]) for r in m.supplier_risk().collect()}
    assert got == {"V1": (17.5, "Low"), "V2": (39.0, "Medium"), "V3": (44.5, "Medium"), "V4": (7.4, "Low"),
                   "V5": (25.0, "Low")}  # the band up to 25 is closed on the right


def test_returns(sample_model):
    from replenish.operators.returns import by_reason, totals
    _, m = sample_model
    assert tuple(totals(m.returns).first()) == (10.75, 3)
    assert {r["reason"]: (r["return_qty"], r["refund_amount"], r["cases"]) for r in by_reason(m.returns).collect()} == {
        "damaged": (2.0, 9.5, 1), "changed_mind": (1.0, 1.25, 1)}
    assert {r["sku"]: r["return_rate"] for r in m.sku_returns().collect()} == dict.fromkeys(("N-1", "N-2", "N-3", "N-4", "N-5"), 0.0)


def test_dead_stock_alerts(sample_model):
    from replenish.operators.outputs import alerts
    _, m = sample_model
    a = alerts(m.base, m.supplier_risk(), m.transfers).collect()
    assert [r["type"] for r in a] == ["dead_stock"] * 4 and sorted(r["rank"] for r in a) == [1, 2, 3, 4]
    assert len(alerts(m.base, m.supplier_risk(), m.transfers, (1, 1, 2)).collect()) == 2


def test_demo_bom_adds_components(spark, sample_model):
    ws, _ = sample_model
    rows = ws.model(PlanParams(demo_bom=True)).base.collect()
    assert len(rows) == 12 and round(sum(r["inventory_value"] for r in rows), 2) == 491.95
    assert sum(r["stockout_risk"] == "Dead-stock risk" for r in rows) == 11
