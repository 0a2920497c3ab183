"""Test inputs: a small invented shop as CSV text, and the hand-worked mini
scenario."""

import datetime as dt
import os

VENDORS_CSV = """supplier_id,supplier_name,country,lead_time_days,lead_time_std_days,on_time_rate,defect_rate,payment_terms,min_order_value
V1,Alder Parts,Norway,12,4,0.90,0.02,Net 10,100
V2,Birch Goods,Chile,30,10,0.80,0.04,Net 20,200
V3,Cedar Mill,Kenya,24,8,0.70,0.06,Net 30,300
V4,Dogwood Ltd,Japan,6,2,0.98,0.01,Net 40,400
V5,Elm Works,Peru,12,4,0.80,0.032,Net 50,500
"""

STOCK_CSV = """sku,product_name,stock_on_hand,warehouse,unit_cost,supplier_id,min_order_qty,storage_class
N-1,Lamp,10,North,2.5,V1,5,standard
N-2,Chair,0,North,4.0,V2,5,fragile
N-3,Rug,7,South,1.1,V3,5,standard
N-4,Vase,30,South,0.75,V4,5,fragile
N-5,Cake,3,South,12,V5,5,cold-chain
"""

ORDERS_CSV = """po_id,sku,supplier_id,ordered_qty,status,order_date,expected_date,unit_cost
P-1,N-1,V1,20,open,2025-01-02,2025-02-02,2.5
P-2,N-2,V2,15,in_transit,2025-01-03,2025-02-03,4
P-3,N-3,V3,40,received,2025-01-04,2025-02-04,1.1
P-4,N-3,V3,5,delayed,2025-01-05,2025-02-05,1.1
"""

RETURNS_CSV = """return_date,sku,return_qty,reason,refund_amount
2025-01-20,N-1,2,damaged,9.5
2025-01-21,N-4,1,changed_mind,1.25
"""


def write_sample_dir(path: str) -> str:
    for name, text in (("vendors", VENDORS_CSV), ("stock_levels", STOCK_CSV), ("purchase_orders", ORDERS_CSV), ("return_log", RETURNS_CSV)):
        with open(os.path.join(path, f"{name}.csv"), "w") as f:
            f.write(text)
    return path


D0 = dt.date(2024, 6, 30)


def day(n: int) -> dt.date:
    return D0 + dt.timedelta(days=n)


def mini_tables(spark, with_bom: bool = False):
    sales = spark.createDataFrame(
        [(day(0), "A", "Alpha", 10.0), (day(-29), "A", "Alpha", 20.0), (day(-100), "A", "Alpha", 7.0),
         (day(-1), "B", "Beta", 90.0)], "date date, sku string, product string, qty double")
    inv_rows = [("A", "Alpha", 0.0, 2.0, "S1", "W1"), ("A", "Alpha", 100.0, 2.0, "S1", "W2"),
                ("B", "Beta", 200.0, 2.0, "S1", "W1"), ("C", "Gamma", 5.0, 2.0, "S1", "W1")]
    if with_bom:
        inv_rows.append(("D", "Delta", 7.0, 2.0, "S1", "W1"))
    inv = spark.createDataFrame(inv_rows, "sku string, product string, stock double, unit_cost double, "
                                          "supplier_id string, warehouse string")
    sup = spark.createDataFrame([("S1", "Supplier One", 9.0, 3.0, 0.9, 0.01)],
                                "supplier_id string, supplier_name string, lead_time_days double, "
                                "lead_time_std_days double, on_time_rate double, defect_rate double")
    ret = spark.createDataFrame([(day(-3), "A", 3.0, "quality_issue", 6.0), (day(-2), "B", 1.0, "changed_mind", 2.0),
                                 (day(-2), "Z", 1.0, "damaged", 1.0)],
                                "return_date date, sku string, return_qty double, reason string, refund_amount double")
    tables = {"sales": sales, "inventory": inv, "suppliers": sup, "returns": ret}
    if with_bom:
        tables["bom"] = spark.createDataFrame([("B", "C", "Gamma", 2.0), ("C", "D", "Delta", 1.0)],
                                              "parent_sku string, component_sku string, component_name string, "
                                              "qty_required double")
    return tables
