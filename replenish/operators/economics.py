"""Service-level cost curves, freight mode trade-off, financial velocity
(O1-O3, F1-F4, V1-V4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions import planning as P
from replenish.functions.planning import dround


def cost_curves(base: DataFrame, holding_rate: float, penalty_mult: float = P.STOCKOUT_PENALTY_MULT,
                levels=P.CURVE_SERVICE_LEVELS) -> DataFrame:
    """O1 (+O2 penalty multiplier): carrying vs stock-out cost per service level.

    The levels are a literal array exploded next to each planning row (a
    narrow Generate, no join); the sums then combine map-side per level."""
    lv = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("service_level")
    rows = base.select("std_daily_demand", "lead_time_days", "unit_cost", "annual_demand_qty", lv)
    c = F.col
    carrying = (P.z_col(c("service_level")) * c("std_daily_demand") * F.sqrt(F.greatest(F.lit(1.0), c("lead_time_days")))
                * c("unit_cost") * float(holding_rate))
    penalty = F.greatest(F.lit(1.0), c("unit_cost") * float(penalty_mult))
    stockout = (F.lit(1.0) - c("service_level")) * c("annual_demand_qty") * penalty
    out = rows.groupBy("service_level").agg(F.sum(carrying).alias("carrying_cost"),
                                            F.sum(stockout).alias("stockout_cost"))
    return out.withColumn("total_cost", c("carrying_cost") + c("stockout_cost"))


def optimal_service_level(curves: DataFrame) -> DataFrame:
    """O3: the level with the lowest total cost (lowest level on a tie)."""
    best = F.min_by(F.struct("service_level", "carrying_cost", "stockout_cost", "total_cost"),
                    F.struct("total_cost", "service_level"))
    return curves.agg(best.alias("b")).select("b.*")


def freight_modes(base: DataFrame, service_level: float) -> DataFrame:
    """ocean vs air per planning row (class holding rate)."""
    c = F.col
    z = P.z_for_service(service_level)
    annual = F.greatest(c("annual_demand_qty"), F.lit(0.0))
    lt_o = F.greatest(c("lead_time_days"), F.lit(1.0))
    lt_a = dround(F.greatest(F.lit(P.AIR_LEAD_FLOOR_DAYS), c("lead_time_days") * P.AIR_LEAD_SHARE), 1)
    fo = dround(c("unit_cost") * P.OCEAN_FREIGHT[0] + P.OCEAN_FREIGHT[1], 2)
    fa = dround(c("unit_cost") * P.AIR_FREIGHT[0] + P.AIR_FREIGHT[1], 2)
    df = base.select("sku", "product", annual.alias("annual_demand"), "unit_cost",
                     lt_o.alias("lead_time_ocean"), lt_a.alias("lead_time_air"),
                     fo.alias("freight_cost_ocean_unit"), fa.alias("freight_cost_air_unit"),
                     "std_daily_demand", "holding_cost_rate", "warehouse")
    h = c("unit_cost") * c("holding_cost_rate")
    df = (df.withColumn("annual_freight_ocean", c("annual_demand") * c("freight_cost_ocean_unit"))
          .withColumn("annual_freight_air", c("annual_demand") * c("freight_cost_air_unit"))
          .withColumn("carrying_cost_ocean", F.lit(z) * c("std_daily_demand") * F.sqrt(c("lead_time_ocean")) * h)
          .withColumn("carrying_cost_air", F.lit(z) * c("std_daily_demand") * F.sqrt(c("lead_time_air")) * h)
          .withColumn("pipeline_cost_ocean", c("annual_demand") * h * (c("lead_time_ocean") / 365.0))
          .withColumn("pipeline_cost_air", c("annual_demand") * h * (c("lead_time_air") / 365.0)))
    df = (df.withColumn("total_cost_ocean", c("annual_freight_ocean") + c("carrying_cost_ocean") + c("pipeline_cost_ocean"))
          .withColumn("total_cost_air", c("annual_freight_air") + c("carrying_cost_air") + c("pipeline_cost_air")))
    df = df.withColumn("recommended_mode", F.when(c("total_cost_air") < c("total_cost_ocean"), F.lit("Air")).otherwise(F.lit("Ocean")))
    return df.withColumn("cost_difference", F.abs(c("total_cost_air") - c("total_cost_ocean"))).drop("std_daily_demand", "holding_cost_rate")


def freight_portfolio(freight: DataFrame) -> DataFrame:
    """mode counts, all-ocean / all-air / optimised totals, savings."""
    c = F.col
    air = c("recommended_mode") == "Air"
    return freight.agg(
        F.sum(F.when(air, 1).otherwise(0)).cast("long").alias("air_count"),
        F.sum(F.when(~air, 1).otherwise(0)).cast("long").alias("ocean_count"),
        F.sum("total_cost_ocean").alias("total_ocean_scenario"),
        F.sum("total_cost_air").alias("total_air_scenario"),
        F.sum(F.when(air, c("total_cost_air")).otherwise(c("total_cost_ocean"))).alias("optimized_cost"),
        F.coalesce(F.sum(F.when(air, c("total_cost_ocean") - c("total_cost_air"))), F.lit(0.0)).alias("savings"),
    )


def freight_long(freight: DataFrame, top: int = 10) -> DataFrame:
    """top rows by annual demand, wide -> long over the two totals."""
    topn = freight.orderBy(F.col("annual_demand").desc(), "sku", "product", "warehouse").limit(top)
    long = topn.unpivot(["sku", "product", "warehouse"], ["total_cost_ocean", "total_cost_air"], "mode_col", "annual_cost")
    label = F.when(F.col("mode_col") == "total_cost_ocean", F.lit("Ocean (Bulk)")).otherwise(F.lit("Air (Express)"))
    return long.select("sku", "product", "warehouse", label.alias("mode"), "annual_cost")


def financial_velocity(base: DataFrame) -> DataFrame:
    """V1: COGS, average inventory value, turnover, days outstanding, carrying."""
    c = F.col
    cogs = F.greatest(c("annual_demand_qty") * c("unit_cost"), F.lit(0.0))
    avg_qty = F.greatest(c("safety_stock") + c("eoq") / 2.0, c("stock"))
    avg_val = F.greatest(avg_qty * c("unit_cost"), F.lit(0.0))
    df = base.select("sku", "product", "storage_class", "warehouse", cogs.alias("annual_cogs"),
                     avg_val.alias("average_inventory_value"), "holding_cost_rate")
    df = df.withColumn("itr", F.when(c("average_inventory_value") > 0, c("annual_cogs") / c("average_inventory_value")).otherwise(F.lit(0.0)))
    df = df.withColumn("dio", F.least(F.when(c("itr") > 0, F.lit(365.0) / c("itr")).otherwise(F.lit(365.0)), F.lit(365.0)))
    return df.withColumn("annual_carrying_cost", c("average_inventory_value") * c("holding_cost_rate")).drop("holding_cost_rate")


def finance_by_class(fin: DataFrame) -> DataFrame:
    """V2."""
    return fin.groupBy("storage_class").agg(
        F.count("sku").alias("sku_count"), F.sum("annual_cogs").alias("annual_cogs"),
        F.sum("average_inventory_value").alias("total_avg_inventory_value"),
        F.sum("annual_carrying_cost").alias("total_annual_carrying_cost"))


def portfolio_ratios(fin: DataFrame) -> DataFrame:
    """V3: ratio of sums; DIO not capped."""
    c = F.col
    s = fin.agg(F.coalesce(F.sum("annual_cogs"), F.lit(0.0)).alias("total_annual_cogs"),
                F.coalesce(F.sum("average_inventory_value"), F.lit(0.0)).alias("total_avg_inventory_value"),
                F.coalesce(F.sum("annual_carrying_cost"), F.lit(0.0)).alias("total_annual_carrying_cost"))
    return s.select("*",
                    F.when(c("total_avg_inventory_value") > 0, c("total_annual_cogs") / c("total_avg_inventory_value")).otherwise(F.lit(0.0)).alias("portfolio_itr"),
                    F.when(c("total_annual_cogs") > 0, F.lit(365.0) * c("total_avg_inventory_value") / c("total_annual_cogs")).otherwise(F.lit(365.0)).alias("portfolio_dio"))
