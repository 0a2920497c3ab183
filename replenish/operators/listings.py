"""Ordered listings and pick lists.

Each returns a lazy, totally ordered DataFrame; Spark sorts with a range
shuffle, so a listing never passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions.planning import inf_to_null


def recipe(bom: DataFrame, parent_sku: str) -> DataFrame:
    """Recipe rows of one parent."""
    return bom.where(F.col("parent_sku") == parent_sku).select("component_sku", "component_name", "qty_required") \
        .orderBy("component_sku")


def parents(bom: DataFrame) -> DataFrame:
    """Distinct parents, sorted."""
    return bom.where(F.col("parent_sku").isNotNull()).select("parent_sku").distinct().orderBy("parent_sku")


def risk_listing(health: DataFrame) -> DataFrame:
    """By risk class, then days of cover (infinite cover last)."""
    return health.select("sku", "product", "warehouse", "stock", "incoming_qty",
                         inf_to_null(F.col("days_of_cover")).alias("days_of_cover"), "lead_time_days",
                         "reorder_point", "shortage_qty", "stockout_risk", "supplier_name") \
        .orderBy(F.col("stockout_risk").asc(), F.col("days_of_cover").asc_nulls_last(), "sku", "warehouse")


def scenario_listing(health: DataFrame) -> DataFrame:
    """Planning rows by recommended quantity, largest first."""
    return health.select("sku", "product", "warehouse", "stock", "avg_daily_demand", "lead_time_days",
                         inf_to_null(F.col("days_of_cover")).alias("days_of_cover"), "reorder_point",
                         "recommended_order_qty", "stockout_risk") \
        .orderBy(F.col("recommended_order_qty").desc(), "sku", "warehouse")


def supplier_names(risk: DataFrame) -> DataFrame:
    """Distinct supplier names, sorted."""
    return risk.where(F.col("supplier_name").isNotNull()).select("supplier_name").distinct().orderBy("supplier_name")


def sku_list(health: DataFrame) -> DataFrame:
    """Distinct SKUs, sorted."""
    return health.select("sku").distinct().orderBy("sku")


def plan_suppliers(plan: DataFrame) -> DataFrame:
    """P7: 'All suppliers' followed by the sorted supplier ids of the plan."""
    ids = plan.where(F.col("supplier_id").isNotNull()).select(F.col("supplier_id").cast("string")).distinct()
    first = plan.sparkSession.createDataFrame([("All suppliers",)], "supplier_id string")
    return first.withColumn("_o", F.lit(0)).unionByName(ids.withColumn("_o", F.lit(1))) \
        .orderBy("_o", "supplier_id").drop("_o")


def freight_listing(freight: DataFrame) -> DataFrame:
    """detail columns by cost difference, largest first."""
    return freight.select("sku", "product", "annual_demand", "unit_cost", "lead_time_ocean", "lead_time_air",
                          "total_cost_ocean", "total_cost_air", "recommended_mode", "cost_difference") \
        .orderBy(F.col("cost_difference").desc(), "sku")


def finance_listing(fin: DataFrame) -> DataFrame:
    """V4: SKU finance by carrying cost, largest first."""
    return fin.select("sku", "product", "storage_class", "annual_cogs", "average_inventory_value", "itr", "dio",
                      "annual_carrying_cost").orderBy(F.col("annual_carrying_cost").desc(), "sku")
