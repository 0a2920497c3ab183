"""CSV files with free-form headers -> workspace -> model gives the same plan
as the typed mini scenario."""

import os

import pytest

from replenish.params import PlanParams
from replenish.plans.model import SupplyModel
from replenish.sources.files import load_dir
from replenish.sources.workspace import Workspace
from tests.fixtures import day, mini_tables


def _write(path, name, text):
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_csv_workspace_matches_typed_frames(spark, tmpdir_path):
    _write(tmpdir_path, "Sales History.csv",
           "Order Date,SKU,Product,Quantity Sold,Revenue\n"
           f"{day(0)},A,Alpha,10,100\n{day(-29)},A,Alpha,20,200\n{day(-100)},A,Alpha,7,70\n"
           f"{day(-1)},B,Beta,90,900\nnot a date,B,Beta,5,50\n")
    _write(tmpdir_path, "stock.csv",
           "SKU,Product Name,Stock On Hand,Unit Cost,Supplier ID,Warehouse\n"
           "A,Alpha,0,2,S1,W1\nA,Alpha,100,2,S1,W2\nB,Beta,200,2,S1,W1\nC,Gamma,5,2,S1,W1\n")
    _write(tmpdir_path, "vendors.csv",
           "Supplier ID,Supplier Name,Lead Time Days,Lead Time Std Days,On Time Rate,Defect Rate\n"
           "S1,Supplier One,9,3,90,0.01\n")
    ws = Workspace(spark).update(load_dir(spark, tmpdir_path))
    roles = ws.roles()
    assert roles["sales"] == "sales_history" and roles["inventory"] == "stock" and roles["suppliers"] == "vendors"
    got = {(r["sku"], r["warehouse"]): r for r in ws.model(PlanParams()).base.collect()}
    exp = {(r["sku"], r["warehouse"]): r for r in SupplyModel(spark, mini_tables(spark), PlanParams()).base.collect()}
    assert set(got) == set(exp)
    for k in exp:
        for c in ("avg_daily_demand", "std_daily_demand", "safety_stock", "reorder_point", "recommended_order_qty",
                  "lead_time_days", "on_time_rate"):
            assert got[k][c] == pytest.approx(exp[k][c]), (k, c)
        assert got[k]["stockout_risk"] == exp[k]["stockout_risk"]
