"""Supplier roll-up, risk score, bands and multi-criteria ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions import planning as P
from replenish.operators.position import first_per_key


def supplier_risk(base: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row per supplier id of the planning rows."""
    c = F.col
    roll = base.groupBy("supplier_id").agg(
        F.sum("inventory_value").alias("supplier_inventory_value"),
        F.count_distinct("sku").alias("supplier_skus"),
        F.avg("lead_time_days").alias("avg_lead_time"),
        F.avg("lead_time_std_days").alias("avg_lead_time_std"),
        F.avg("on_time_rate").alias("avg_on_time_rate"),
        F.avg("defect_rate").alias("avg_defect_rate"),
        F.sum(F.when(c("stockout_risk") == P.RISK_CRITICAL, 1).otherwise(0)).cast("long").alias("critical_skus"),
        F.sum(F.when(c("stockout_risk").isin(P.RISK_CRITICAL, P.RISK_HIGH), 1).otherwise(0)).cast("long").alias("high_risk_skus"),
        F.sum("recommended_order_value").alias("recommended_order_value"),
        F.avg("unit_cost").alias("avg_unit_cost"),
    )
    score = P.supplier_risk_score(c("avg_on_time_rate"), c("avg_defect_rate"), c("avg_lead_time"),
                                  c("avg_lead_time_std"), c("high_risk_skus"))
    roll = roll.withColumn("supplier_risk_score", score)
    # First supplier row per id (input order is not kept by Spark; the
    # lowest name wins, deterministic)
    details = first_per_key(suppliers, ["supplier_id"], [F.col("supplier_name")],
                            ["supplier_name", "country", "payment_terms", "min_order_value"])
    out = roll.join(details, "supplier_id", "left")
    return out.withColumn("risk_level", P.risk_band(c("supplier_risk_score")))


def mcda(risk: DataFrame, w_price: float = P.MCDA_WEIGHTS[0], w_speed: float = P.MCDA_WEIGHTS[1],
         w_reliability: float = P.MCDA_WEIGHTS[2], w_quality: float = P.MCDA_WEIGHTS[3]) -> DataFrame:
    """P5: min-max scaled price and lead-time scores (100 when flat), on-time
    and quality scores, weighted mean; numeric outputs rounded to 2.

    The extremes come from one scalar subquery (a combinable aggregation)."""
    c = F.col
    # one scalar subquery returning all four extremes
    ext = risk.select(F.struct(F.max("avg_unit_cost").alias("a"), F.min("avg_unit_cost").alias("b"),
                               F.max("avg_lead_time").alias("c"), F.min("avg_lead_time").alias("d"))).scalar()
    max_p, min_p, max_l, min_l = (ext.getField(k) for k in "abcd")
    sp = F.when(max_p != min_p, (max_p - c("avg_unit_cost")) * 100 / (max_p - min_p)).otherwise(F.lit(100.0))
    ss = F.when(max_l != min_l, (max_l - c("avg_lead_time")) * 100 / (max_l - min_l)).otherwise(F.lit(100.0))
    total_w = w_price + w_speed + w_reliability + w_quality
    total_w = total_w if total_w > 0 else 1.0
    df = (risk.withColumn("score_price", sp).withColumn("score_speed", ss)
          .withColumn("score_reliability", c("avg_on_time_rate") * 100)
          .withColumn("score_quality", (F.lit(1.0) - c("avg_defect_rate")) * 100))
    df = df.withColumn("mcda_score", (c("score_price") * w_price + c("score_speed") * w_speed
                                      + c("score_reliability") * w_reliability
                                      + c("score_quality") * w_quality) / total_w)
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.select(*[P.dround(c(n), 2).alias(n) if n in numeric else c(n) for n in df.columns])
