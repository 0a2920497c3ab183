"""Fixed contracts of the six role tables after standardisation."""

from pyspark.sql import types as T

S, D, DT, B = T.StringType(), T.DoubleType(), T.DateType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SALES = _struct(("date", DT), ("sku", S), ("product", S), ("qty", D), ("revenue", D), ("cost", D),
                ("profit", D), ("region", S), ("channel", S), ("segment", S))
INVENTORY = _struct(("sku", S), ("product", S), ("stock", D), ("unit_cost", D), ("supplier_id", S),
                    ("warehouse", S), ("min_order_qty", D), ("storage_class", S))
SUPPLIERS = _struct(("supplier_id", S), ("supplier_name", S), ("lead_time_days", D),
                    ("lead_time_std_days", D), ("on_time_rate", D), ("defect_rate", D), ("country", S),
                    ("payment_terms", S), ("min_order_value", D))
PURCHASE_ORDERS = _struct(("po_id", S), ("sku", S), ("supplier_id", S), ("ordered_qty", D), ("status", S),
                          ("order_date", DT), ("expected_date", DT), ("unit_cost", D))
RETURNS = _struct(("date", DT), ("sku", S), ("return_qty", D), ("reason", S), ("refund_amount", D))
BOM = _struct(("parent_sku", S), ("component_sku", S), ("component_name", S), ("qty_required", D))

ROLES = {
    "sales": SALES,
    "inventory": INVENTORY,
    "suppliers": SUPPLIERS,
    "purchase_orders": PURCHASE_ORDERS,
    "returns": RETURNS,
    "bom": BOM,
}

ALERT = _struct(("seq", T.LongType()), ("type", S), ("priority", S), ("sku", S), ("supplier_id", S),
                ("message", S), ("recommended_action", S))
