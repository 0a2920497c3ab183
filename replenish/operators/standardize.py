"""Role standardisation: resolve columns by name, coerce types, apply defaults.

Each function maps an arbitrary input frame onto the fixed contract in
``replenish.schemas``; it is one projection (plus a filter) that Catalyst
pushes column pruning through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish import schemas
from replenish.functions import planning as P
from replenish.functions.columns import as_date, as_double, as_double_or, as_text
from replenish.functions.naming import find_col

# Candidate column names per role field, in priority order.
SALES_CANDIDATES = {
    "date": ["date", "order_date", "sale_date", "transaction_date", "created_at", "invoice_date"],
    "sku": ["sku", "product_id", "item_id", "item_code", "product_code"],
    "product": ["product", "product_name", "item", "item_name", "name"],
    "qty": ["quantity_sold", "quantity", "qty", "units", "units_sold", "sold_qty"],
    "revenue": ["revenue", "sales", "amount", "total", "gross_sales", "net_sales"],
    "cost": ["cost", "cogs", "total_cost", "purchase_cost"],
    "profit": ["profit", "gross_profit", "margin_value"],
    "region": ["region", "state", "city", "country", "market"],
    "channel": ["channel", "source", "store", "platform"],
    "segment": ["segment", "customer_segment", "customer_type", "tier"],
    "price": ["unit_price", "price", "selling_price"],
    "unit_cost": ["unit_cost", "cost_per_unit"],
}
INVENTORY_CANDIDATES = {
    "sku": ["sku", "product_id", "item_id", "item_code", "product_code"],
    "product": ["product", "product_name", "item", "item_name", "name"],
    "stock": ["stock_on_hand", "stock", "inventory", "stock_quantity", "qty_on_hand", "available_qty"],
    "unit_cost": ["unit_cost", "cost", "purchase_cost", "standard_cost"],
    "supplier_id": ["supplier_id", "vendor_id", "supplier", "vendor"],
    "warehouse": ["warehouse", "location", "dc", "fulfillment_center"],
    "min_order_qty": ["min_order_qty", "moq", "minimum_order_quantity"],
    "storage_class": ["storage_class", "class", "storage_type"],
}
SUPPLIER_CANDIDATES = {
    "supplier_id": ["supplier_id", "vendor_id", "supplier", "vendor"],
    "supplier_name": ["supplier_name", "vendor_name", "name", "supplier"],
    "lead_time_days": ["lead_time_days", "lead_time", "avg_lead_time", "delivery_days"],
    "lead_time_std_days": ["lead_time_std_days", "lead_time_std", "delay_std", "lead_time_variability"],
    "on_time_rate": ["on_time_rate", "on_time_delivery", "otd", "service_level"],
    "defect_rate": ["defect_rate", "return_rate", "quality_issue_rate"],
    "country": ["country", "region", "location"],
    "payment_terms": ["payment_terms", "terms"],
    "min_order_value": ["min_order_value", "minimum_order_value", "mov"],
}
PO_CANDIDATES = {
    "po_id": ["po_id", "purchase_order", "order_id"],
    "sku": ["sku", "product_id", "item_id", "item_code", "product_code"],
    "supplier_id": ["supplier_id", "vendor_id", "supplier", "vendor"],
    "ordered_qty": ["ordered_qty", "quantity", "qty", "po_qty", "order_qty"],
    "status": ["status", "po_status", "state"],
    "order_date": ["order_date", "created_at", "po_date"],
    "expected_date": ["expected_date", "eta", "delivery_date", "expected_delivery"],
    "unit_cost": ["unit_cost", "cost", "purchase_cost"],
}
RETURN_CANDIDATES = {
    "date": ["return_date", "date", "created_at"],
    "sku": ["sku", "product_id", "item_id", "product_code"],
    "return_qty": ["return_qty", "quantity", "qty"],
    "reason": ["reason", "return_reason", "category"],
    "refund_amount": ["refund_amount", "amount", "refund", "value"],
}
BOM_CANDIDATES = {
    "parent_sku": ["parent_sku", "parent", "finished_sku", "sku"],
    "component_sku": ["component_sku", "component", "child_sku"],
    "component_name": ["component_name", "name", "component_title", "title"],
    "qty_required": ["qty_required", "quantity", "qty", "units_required"],
}


def _resolve(df: DataFrame, candidates: dict, match: str) -> dict:
    return {k: find_col(df.columns, v, match) for k, v in candidates.items()}


def empty(spark: SparkSession, role: str) -> DataFrame:
    return spark.createDataFrame([], schemas.ROLES[role])


def _all_null(df: DataFrame, c) -> "F.Column":
    """Scalar subquery: TRUE when the coerced column has no value at all."""
    return df.select((F.count(c) == 0).alias("n")).scalar()


def standardize_sales(df: DataFrame, match: str = "compat") -> DataFrame:
    m = _resolve(df, SALES_CANDIDATES, match)
    qty = as_double_or(df, m["qty"], 1.0)
    revenue_raw = as_double(df, m["revenue"])
    if m["revenue"] is None:
        revenue = (qty * as_double_or(df, m["price"], 0.0)) if m["price"] else F.lit(0.0)
    elif m["price"]:
        revenue = F.when(_all_null(df, revenue_raw), qty * as_double_or(df, m["price"], 0.0)).otherwise(revenue_raw)
    else:
        # all-NULL -> 0.0; otherwise NULL stays NULL, which every sum treats as 0
        revenue = F.coalesce(revenue_raw, F.lit(0.0))
    cost_raw = as_double(df, m["cost"])
    uc_fallback = (qty * as_double_or(df, m["unit_cost"], 0.0)) if m["unit_cost"] else F.lit(0.0)
    if m["cost"] is None:
        cost = uc_fallback
    elif m["unit_cost"]:
        cost = F.when(_all_null(df, cost_raw), uc_fallback).otherwise(cost_raw)
    else:
        cost = F.coalesce(cost_raw, F.lit(0.0))
    # profit keeps NULL when revenue or cost is NULL (skipped by sums)
    rev_for_profit = revenue_raw if (m["revenue"] is not None and not m["price"]) else revenue
    cost_for_profit = cost_raw if (m["cost"] is not None and not m["unit_cost"]) else cost
    profit = as_double(df, m["profit"]) if m["profit"] else rev_for_profit - cost_for_profit
    sku = as_text(m["sku"], "UNKNOWN")
    out = df.select(
        as_date(df, m["date"]).alias("date"),
        sku.alias("sku"),
        (as_text(m["product"], "") if m["product"] else sku).alias("product"),
        F.greatest(qty, F.lit(0.0)).alias("qty"),
        revenue.alias("revenue"),
        cost.alias("cost"),
        profit.alias("profit"),
        as_text(m["region"], "Unassigned").alias("region"),
        as_text(m["channel"], "Unassigned").alias("channel"),
        as_text(m["segment"], "Unassigned").alias("segment"),
    )
    return out.where(F.col("date").isNotNull())


def standardize_inventory(df: DataFrame, match: str = "compat") -> DataFrame:
    m = _resolve(df, INVENTORY_CANDIDATES, match)
    sku = as_text(m["sku"], "") if m["sku"] else F.monotonically_increasing_id().cast("string")
    return df.select(
        sku.alias("sku"),
        (as_text(m["product"], "") if m["product"] else sku).alias("product"),
        as_double_or(df, m["stock"], 0.0).alias("stock"),
        as_double_or(df, m["unit_cost"], 0.0).alias("unit_cost"),
        as_text(m["supplier_id"], "UNKNOWN").alias("supplier_id"),
        as_text(m["warehouse"], "Unassigned").alias("warehouse"),
        as_double_or(df, m["min_order_qty"], 1.0).alias("min_order_qty"),
        F.lower(as_text(m["storage_class"], "standard")).alias("storage_class"),
    )


def _rate(c):
    return F.when(c > 1, c / 100).otherwise(c)


def standardize_suppliers(df: DataFrame, match: str = "compat") -> DataFrame:
    m = _resolve(df, SUPPLIER_CANDIDATES, match)
    sid = as_text(m["supplier_id"], "") if m["supplier_id"] else F.monotonically_increasing_id().cast("string")
    return df.select(
        sid.alias("supplier_id"),
        (as_text(m["supplier_name"], "") if m["supplier_name"] else sid).alias("supplier_name"),
        as_double_or(df, m["lead_time_days"], P.DEFAULT_LEAD_TIME_DAYS).alias("lead_time_days"),
        as_double_or(df, m["lead_time_std_days"], P.DEFAULT_LEAD_TIME_STD_DAYS).alias("lead_time_std_days"),
        _rate(as_double_or(df, m["on_time_rate"], P.DEFAULT_ON_TIME_RATE)).alias("on_time_rate"),
        _rate(as_double_or(df, m["defect_rate"], P.DEFAULT_DEFECT_RATE)).alias("defect_rate"),
        as_text(m["country"], "Unknown").alias("country"),
        as_text(m["payment_terms"], "Unknown").alias("payment_terms"),
        as_double_or(df, m["min_order_value"], 0.0).alias("min_order_value"),
    )


def standardize_pos(df: DataFrame, match: str = "compat", as_of=None) -> DataFrame:
    m = _resolve(df, PO_CANDIDATES, match)
    today = F.lit(as_of) if as_of is not None else F.current_date()
    pid = as_text(m["po_id"], "") if m["po_id"] else F.monotonically_increasing_id().cast("string")
    return df.select(
        pid.alias("po_id"),
        as_text(m["sku"], "UNKNOWN").alias("sku"),
        as_text(m["supplier_id"], "UNKNOWN").alias("supplier_id"),
        as_double_or(df, m["ordered_qty"], 0.0).alias("ordered_qty"),
        F.lower(as_text(m["status"], "open")).alias("status"),
        (as_date(df, m["order_date"]) if m["order_date"] else today).alias("order_date"),
        (as_date(df, m["expected_date"]) if m["expected_date"] else F.date_add(today, 10)).alias("expected_date"),
        as_double_or(df, m["unit_cost"], 0.0).alias("unit_cost"),
    )


def standardize_returns(df: DataFrame, match: str = "compat") -> DataFrame:
    m = _resolve(df, RETURN_CANDIDATES, match)
    return df.select(
        as_date(df, m["date"]).alias("date"),
        as_text(m["sku"], "UNKNOWN").alias("sku"),
        as_double_or(df, m["return_qty"], 1.0).alias("return_qty"),
        as_text(m["reason"], "Unassigned").alias("reason"),
        as_double_or(df, m["refund_amount"], 0.0).alias("refund_amount"),
    ).where(F.col("date").isNotNull())


def standardize_bom(df: DataFrame, match: str = "compat") -> DataFrame:
    m = _resolve(df, BOM_CANDIDATES, match)
    comp = as_text(m["component_sku"], "UNKNOWN")
    return df.select(
        (as_text(m["parent_sku"], "UNKNOWN") if m["parent_sku"] else F.lit(None).cast("string")).alias("parent_sku"),
        comp.alias("component_sku"),
        (as_text(m["component_name"], "") if m["component_name"] else comp).alias("component_name"),
        as_double_or(df, m["qty_required"], 1.0).alias("qty_required"),
    )


STANDARDIZERS = {
    "sales": standardize_sales,
    "inventory": standardize_inventory,
    "suppliers": standardize_suppliers,
    "purchase_orders": standardize_pos,
    "returns": standardize_returns,
    "bom": standardize_bom,
}


def standardize(role: str, df: DataFrame | None, spark: SparkSession, match: str = "compat", **kw) -> DataFrame:
    if df is None:
        return empty(spark, role)
    return STANDARDIZERS[role](df, match=match, **kw)
