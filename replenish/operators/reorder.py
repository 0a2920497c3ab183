"""Reorder mathematics, risk, flags and ABC classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions import planning as P
from replenish.operators.scan import running
from replenish.params import PlanParams

REORDER_PLAN_COLS = ["sku", "product", "supplier_id", "supplier_name", "stock", "incoming_qty",
                     "avg_daily_demand", "days_of_cover", "lead_time_days", "safety_stock", "reorder_point",
                     "recommended_order_qty", "recommended_order_value", "stockout_risk", "abc_class"]

# Deterministic tie-break appended to every order over planning rows.
TIE = ["sku", "product", "warehouse"]


def reorder_columns(df: DataFrame, params: PlanParams, z=None, order_cost=None) -> DataFrame:
    """R2, R4-R12 as one projection (whole-stage codegen, no shuffle).

    Expects demand columns, stock, unit_cost, min_order_qty, storage_class,
    lead_time_days and incoming_qty."""
    z = P.z_for_service(params.service_level) if z is None else z
    oc = max(float(params.order_cost), P.MIN_ORDER_COST) if order_cost is None else order_cost
    c = F.col
    df = df.withColumn("holding_cost_rate", P.holding_rate(c("storage_class"), float(params.holding_cost_rate)))
    df = df.withColumn("safety_stock", P.safety_stock(z, c("std_daily_demand"), c("lead_time_days")))
    df = df.withColumn("reorder_point", P.reorder_point(c("avg_daily_demand"), c("lead_time_days"), c("safety_stock")))
    df = df.withColumn("days_of_cover", P.days_of_cover(c("stock"), c("avg_daily_demand")))
    df = df.withColumn("net_position", c("stock") + c("incoming_qty"))
    df = df.withColumn("shortage_qty", F.greatest(c("reorder_point") - c("net_position"), F.lit(0.0)))
    df = df.withColumn("eoq", P.eoq(c("annual_demand_qty"), c("unit_cost"), c("holding_cost_rate"), oc))
    df = df.withColumn("recommended_order_qty", P.recommended_qty(c("shortage_qty"), c("eoq"), c("min_order_qty")))
    df = df.withColumn("inventory_value", c("stock") * c("unit_cost"))
    df = df.withColumn("recommended_order_value", c("recommended_order_qty") * c("unit_cost"))
    df = df.withColumn("stockout_risk", P.stockout_risk(c("avg_daily_demand"), c("stock"), c("days_of_cover"),
                                                        c("lead_time_days"), c("net_position"), c("reorder_point")))
    df = df.withColumn("dead_stock_flag", (c("avg_daily_demand") < P.DEAD_STOCK_MAX_DEMAND) & (c("stock") > 0))
    df = df.withColumn("overstock_flag", (c("days_of_cover") > P.OVERSTOCK_COVER_DAYS) & (c("stock") > 0))
    return df


def revenue_order():
    return [F.col("annual_revenue").desc(), *[F.col(t).asc() for t in TIE]]


def abc_classes(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Running revenue share in revenue-descending order; <= .80 A,
    <= .95 B, else C; all C (share 0) when total revenue is not positive.

    Uses the two-pass range-partitioned scan, not a global window."""
    tot = df.select(F.sum("annual_revenue")).scalar()
    scanned = running(df, revenue_order(), {"_cum_rev": (F.col("annual_revenue"), "sum")}, partitions=partitions)
    share = F.when(tot > 0, F.col("_cum_rev") / tot).otherwise(F.lit(0.0))
    out = scanned.withColumn("cum_revenue_pct", share)
    cls = (F.when(tot <= 0, F.lit("C"))
           .when(F.col("cum_revenue_pct") <= P.ABC_A_SHARE, F.lit("A"))
           .when(F.col("cum_revenue_pct") <= P.ABC_B_SHARE, F.lit("B"))
           .otherwise(F.lit("C")))
    return out.withColumn("abc_class", cls).drop("_cum_rev")


def reorder_plan(health: DataFrame) -> DataFrame:
    """Rows with something to order, plan columns."""
    return health.where(F.col("recommended_order_qty") > 0).select(*REORDER_PLAN_COLS, "warehouse", "annual_revenue")


def classed_plan(df: DataFrame) -> DataFrame:
    """R14 of planning rows that have no ABC classes yet. Rows with nothing to order count towards the running revenue
    alone, so they pass the scan as their order keys, the others with the plan's columns."""
    cols = [c for c in REORDER_PLAN_COLS if c not in ("abc_class", *TIE)]
    plan = F.when(F.col("recommended_order_qty") > 0, F.struct(*cols)).alias("_plan")
    found = abc_classes(df.select(*TIE, "annual_revenue", plan)).where(F.col("_plan").isNotNull())
    named = {c: F.col("_plan").getField(c).alias(c) for c in cols}
    return found.select(*[named.get(c, F.col(c)) for c in REORDER_PLAN_COLS], "warehouse", "annual_revenue")


def plan_order():
    """R14 order: risk text ascending, order value descending, then base order."""
    return [F.col("stockout_risk").asc(), F.col("recommended_order_value").desc(), *revenue_order()]


def health_order():
    """R15 order: risk text ascending, inventory value descending."""
    return [F.col("stockout_risk").asc(), F.col("inventory_value").desc(), *[F.col(t).asc() for t in TIE]]


def risk_distribution(health: DataFrame) -> DataFrame:
    """Rows per risk class."""
    return health.groupBy(F.col("stockout_risk").alias("risk")).agg(F.count(F.lit(1)).alias("count"))


def calc_breakdown(health: DataFrame, params: PlanParams) -> DataFrame:
    """Every term of the recommendation per planning row."""
    z = P.z_for_service(params.service_level)
    return health.select(
        "sku", "product", "warehouse",
        "avg_daily_demand", "lead_time_days",
        (F.col("avg_daily_demand") * F.col("lead_time_days")).alias("lead_time_demand"),
        F.lit(z).alias("z"),
        "std_daily_demand", "safety_stock", "reorder_point", "stock", "incoming_qty", "net_position",
        "shortage_qty", "annual_demand_qty", F.lit(float(params.order_cost)).alias("order_cost"),
        "holding_cost_rate", "unit_cost", "eoq", "min_order_qty", "recommended_order_qty",
    )
