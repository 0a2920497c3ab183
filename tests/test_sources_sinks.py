import json
import os

import pytest

from replenish.operators.standardize import standardize_inventory, standardize_sales
from replenish.sources.files import load_dir, load_files, read_csv, read_json
from replenish.sources.jdbc import jdbc_tables


def test_csv_reads_strings_and_standardizes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "Stock File.csv")
    with open(p, "w") as f:
        f.write("SKU,Product Name,Stock On Hand,Unit Cost\nX1,Thing,12,oops\n,Other,,3.5\n")
    tables = load_files(spark, [p])
    df = tables["stock_file"]
    assert df.columns == ["sku", "product_name", "stock_on_hand", "unit_cost"]
    rows = standardize_inventory(df).orderBy("product").collect()
    assert rows[0]["stock"] == 0.0 and rows[0]["unit_cost"] == 3.5 and rows[0]["sku"] == ""
    assert rows[1]["unit_cost"] == 0.0 and rows[1]["warehouse"] == "Unassigned" and rows[1]["storage_class"] == "standard"


def test_sales_revenue_fallback_only_when_column_all_null(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 2.0, None, 5.0), ("2024-01-02", "a", 1.0, None, 4.0)],
                               "date string, sku string, qty double, revenue double, unit_price double")
    r = standardize_sales(df).orderBy("date").collect()
    assert [x["revenue"] for x in r] == [10.0, 4.0]
    df2 = spark.createDataFrame([("2024-01-01", "a", 2.0, 7.0, 5.0), ("2024-01-02", "a", 1.0, None, 4.0)],
                                "date string, sku string, qty double, revenue double, unit_price double")
    r2 = standardize_sales(df2).orderBy("date").collect()
    assert r2[0]["revenue"] == 7.0 and r2[1]["revenue"] is None


def test_missing_date_column_gives_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0)], "sku string, qty double")
    assert standardize_sales(df).count() == 0


def test_json_array_and_lines(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "a.json")
    with open(a, "w") as f:
        json.dump([{"SKU": "x", "Qty": 1}, {"SKU": "y", "Qty": 2}], f)
    assert read_json(spark, a).count() == 2
    b = os.path.join(tmpdir_path, "b.json")
    with open(b, "w") as f:
        f.write('{"sku": "x"}\n{"sku": "y"}\n')
    assert read_json(spark, b).columns == ["sku"]


def test_column_oriented_json_is_rejected(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.json")
    with open(p, "w") as f:
        json.dump({"sku": {"0": "A", "1": "B"}, "qty": {"0": 1, "1": 2}}, f)
    with pytest.raises(ValueError):
        read_json(spark, p)


def test_folder_is_listed_in_order(spark, tmpdir_path):
    for name in ("b Sales", "a", "skip"):
        with open(os.path.join(tmpdir_path, f"{name}.{'txt' if name == 'skip' else 'csv'}"), "w") as f:
            f.write("sku,qty\nx,1\n")
    assert list(load_dir(spark, tmpdir_path)) == ["a", "b_sales"]


def test_jdbc_whitelist(spark):
    with pytest.raises(ValueError):
        jdbc_tables(spark, "jdbc:sqlite:x", "bad name;")
    from replenish.functions.naming import check_identifier
    with pytest.raises(ValueError):
        check_identifier("foo\n")
    assert jdbc_tables(spark, "", "a") == {}


def test_sinks(spark, tmpdir_path):
    from replenish.operators.outputs import playbooks
    from replenish.sinks.export import automation_payload, preview, write_audit, write_csv
    df = spark.createDataFrame([("a", float("inf")), ("b", 1.5)], "sku string, cover double")
    write_csv(df, os.path.join(tmpdir_path, "csv"), ["sku"])
    back = read_csv(spark, os.path.join(tmpdir_path, "csv")).orderBy("sku").collect()
    assert back[0]["cover"] is None and back[1]["cover"] == "1.5"
    write_audit({"t": df}, os.path.join(tmpdir_path, "audit"), cap=1, orders={"t": ["sku"]})
    assert spark.read.json(os.path.join(tmpdir_path, "audit", "t")).count() == 1
    assert preview(df, ["sku"]).first()["cover"] == "∞"
    al = spark.createDataFrame([(1, 1, "dead_stock", "P3", "a", None, "m", "x")],
                               "alert_group int, rank long, type string, priority string, sku string, "
                               "supplier_id string, message string, recommended_action string")
    doc = json.loads(automation_payload(playbooks(spark), al, "/x/transfers").first()[0])
    assert doc["approval_policy"]["safe_mode"] is True and len(doc["automation_playbooks"]) == 5
    assert doc["alerts"][0]["type"] == "dead_stock"


def test_model_exports(spark, tmpdir_path):
    from replenish.params import PlanParams
    from replenish.plans.model import SupplyModel
    from tests.fixtures import mini_tables
    m = SupplyModel(spark, mini_tables(spark), PlanParams())
    m.export_audit(os.path.join(tmpdir_path, "audit"))
    assert spark.read.json(os.path.join(tmpdir_path, "audit", "inventory_health")).count() == 4
    m.export_bundle(os.path.join(tmpdir_path, "bundle"))
    assert os.path.isdir(os.path.join(tmpdir_path, "bundle", "freight_optimization"))
    doc = json.loads(m.automation(os.path.join(tmpdir_path, "auto")).first()[0])
    assert doc["transfers_path"].endswith("/transfers") and len(doc["automation_playbooks"]) == 5


def test_empty_plan_draft(spark):
    from replenish.operators.outputs import DRAFT_EMPTY, procurement_drafts
    plan = spark.createDataFrame([], "supplier_id string, sku string, product string, recommended_order_qty double, "
                                     "stockout_risk string, recommended_order_value double, annual_revenue double, "
                                     "warehouse string")
    assert [tuple(r) for r in procurement_drafts(plan).collect()] == [("All suppliers", DRAFT_EMPTY)]


def test_cluster_conf_sizes_partitions():
    from replenish.session import cluster_conf
    c = cluster_conf(100 * 2 ** 40, executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600


def test_load_dir_reads_folders_of_part_files(spark, tmpdir_path):
    rows = [(str(i), i) for i in range(6)]
    spark.createDataFrame(rows, "sku string, qty long").repartition(3).write.option("header", True).csv(os.path.join(tmpdir_path, "sales.csv"))
    with open(os.path.join(tmpdir_path, "stock.csv"), "w") as f:
        f.write("sku,stock\n1,5\n")
    with open(os.path.join(tmpdir_path, "_hidden.csv"), "w") as f:
        f.write("a\n1\n")
    got = load_dir(spark, tmpdir_path)
    assert list(got) == ["sales", "stock"] and got["stock"].count() == 1
    assert sorted((r.sku, int(r.qty)) for r in got["sales"].collect()) == rows
