"""Returns and quality analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions.planning import QUALITY_REASONS
from replenish.operators.position import first_per_key


def totals(returns: DataFrame) -> DataFrame:
    """Total refund and int(total units)."""
    return returns.agg(
        F.coalesce(F.sum("refund_amount"), F.lit(0.0)).alias("total_refund_value"),
        F.coalesce(F.sum("return_qty"), F.lit(0.0)).cast("long").alias("total_returns_qty"))


def by_reason(returns: DataFrame) -> DataFrame:
    """T2."""
    return returns.groupBy("reason").agg(
        F.sum("return_qty").alias("return_qty"), F.sum("refund_amount").alias("refund_amount"),
        F.count("return_qty").alias("cases"))


def sku_first(base: DataFrame) -> DataFrame:
    """First planning row per sku in planning (revenue-descending) order."""
    return first_per_key(base, ["sku"], [-F.col("annual_revenue"), F.col("product"), F.col("warehouse")],
                         ["product", "supplier_id", "supplier_name", "unit_cost"])


def sku_return_rate(base: DataFrame, returns: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per planning sku, none at all without any returns, as in
    the original; return rate = clip(returned / sold, 0, 1),
    0 without sales (sales over all history; ``sales`` may be the shared
    (sku, product, date) history aggregate)."""
    ret = returns.groupBy("sku").agg(F.sum("return_qty").alias("total_return_qty"),
                                     F.sum("refund_amount").alias("total_refund_amount"))
    sold = sales.groupBy("sku").agg(F.sum("qty").alias("total_sales_qty"))
    j = sku_first(base).join(ret, "sku", "left").join(sold, "sku", "left")
    j = j.fillna({"total_return_qty": 0.0, "total_refund_amount": 0.0, "total_sales_qty": 0.0})
    rate = F.when(F.col("total_sales_qty") > 0,
                  F.least(F.greatest(F.col("total_return_qty") / F.col("total_sales_qty"), F.lit(0.0)), F.lit(1.0))
                  ).otherwise(F.lit(0.0))
    return j.withColumn("return_rate", rate).where(returns.select(F.count(F.lit(1))).scalar() > 0)


def supplier_returns(base: DataFrame, returns: DataFrame) -> DataFrame:
    """T4 + T5: returns attributed through each sku's first planning row;
    rows without a supplier are dropped. Quality units in the same pass."""
    owner = sku_first(base).select("sku", "supplier_id", "supplier_name")
    j = returns.join(owner, "sku", "left").where(F.col("supplier_id").isNotNull() & F.col("supplier_name").isNotNull())
    return j.groupBy("supplier_id", "supplier_name").agg(
        F.sum("return_qty").alias("supplier_return_qty"),
        F.sum("refund_amount").alias("supplier_refund_amount"),
        F.coalesce(F.sum(F.when(F.col("reason").isin(*QUALITY_REASONS), F.col("return_qty"))), F.lit(0.0))
        .cast("long").alias("supplier_quality_return_qty"),
    )


def defect_correlation(sup_returns: DataFrame, risk: DataFrame) -> DataFrame:
    """Supplier returns next to the supplier's average defect rate."""
    return sup_returns.join(risk.select("supplier_id", "avg_defect_rate"), "supplier_id", "left")


def overall_return_rate(returns: DataFrame, sales: DataFrame) -> DataFrame:
    """int(returned units) / total sold units (denominator 1 without sales)."""
    r = returns.agg(F.coalesce(F.sum("return_qty"), F.lit(0.0)).cast("long").alias("total_returns_qty"))
    s = sales.agg(F.sum("qty").alias("total_sales_qty"))
    sold = s.select("total_sales_qty").scalar()
    denom = F.coalesce(sold, F.lit(1.0))
    return r.select("total_returns_qty", denom.alias("total_sales_qty"),
                    F.when(denom > 0, F.col("total_returns_qty") / denom).otherwise(F.lit(0.0)).alias("return_rate"))
