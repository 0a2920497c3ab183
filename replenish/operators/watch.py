"""Playbook conditions built as queries (E1-E5): the original lists these
rules as text; here each one is a filter over the planning results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.functions import planning as P
from replenish.operators.position import open_po_filter


def stockout_watch(base: DataFrame) -> DataFrame:
    """Rows with Critical or High stock-out risk."""
    return base.where(F.col("stockout_risk").isin(P.RISK_CRITICAL, P.RISK_HIGH)).select(
        "sku", "product", "warehouse", "supplier_id", "stockout_risk", "days_of_cover", "recommended_order_qty",
        "recommended_order_value")


def supplier_delay_watch(pos: DataFrame, risk: DataFrame, as_of: Column, score_limit: float = 75.0) -> DataFrame:
    """Open POs whose expected date has passed, or whose supplier scores
    above ``score_limit``."""
    op = open_po_filter(pos)
    j = op.join(risk.select("supplier_id", "supplier_risk_score"), "supplier_id", "left")
    late = F.col("expected_date") < as_of
    risky = F.coalesce(F.col("supplier_risk_score") > score_limit, F.lit(False))
    return j.where(late | risky).select(
        "po_id", "sku", "supplier_id", "status", "expected_date", "ordered_qty", "supplier_risk_score",
        late.alias("eta_breached"), risky.alias("supplier_risky"))


def dead_stock_cleanup(base: DataFrame) -> DataFrame:
    """Cover above 90 days or mean demand below 0.2 (note: or)."""
    c = F.col
    return base.where((c("days_of_cover") > 90) | (c("avg_daily_demand") < 0.2)).select(
        "sku", "product", "warehouse", "stock", "days_of_cover", "avg_daily_demand", "inventory_value")


def budget_guardrail(plan: DataFrame, monthly_budget: float) -> DataFrame:
    """E5: plan value per supplier and in total against a budget."""
    per = plan.groupBy("supplier_id").agg(F.sum("recommended_order_value").alias("order_value"))
    tot = plan.agg(F.sum("recommended_order_value").alias("order_value")).select(
        F.lit("ALL").alias("supplier_id"), F.coalesce("order_value", F.lit(0.0)).alias("order_value"))
    out = per.unionByName(tot)
    return out.select("supplier_id", "order_value", (F.col("order_value") > monthly_budget).alias("needs_finance_approval"))
