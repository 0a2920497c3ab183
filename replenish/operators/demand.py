"""Demand statistics over the trailing window.

The dense calendar of the original (every SKU x every day, zeros filled) is
never materialised for the statistics: with N = window days, the mean is
sum/N and the sample deviation follows from the sums of q and q^2 over the
days that had sales. Two aggregations share the (sku, product) key prefix,
and the first one combines map-side, so a SKU holding a large share of the
rows is reduced to at most N rows per task before any shuffle."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replenish.functions import planning as P
from replenish.params import PlanParams


def anchor_date(sales: DataFrame) -> _dt.date | None:
    """Latest sale date, fetched as one tiny job so that the window filter is
    a literal the scan can prune on (row groups / date partitions)."""
    return sales.select(F.max("date")).first()[0]


def window_bounds(sales: DataFrame, params: PlanParams, anchor: _dt.date | None = None):
    anchor = anchor or anchor_date(sales)
    if anchor is None:
        return None, None
    return anchor - _dt.timedelta(days=params.window_days - 1), anchor


def daily_demand(sales: DataFrame, lo: _dt.date, hi: _dt.date) -> DataFrame:
    """D1 + D2: trailing-window filter and (sku, product, date) sums."""
    recent = sales.where((F.col("date") >= F.lit(lo)) & (F.col("date") <= F.lit(hi)))
    return recent.groupBy("sku", "product", "date").agg(
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("profit"), F.lit(0.0)).alias("profit"),
    )


def dense_calendar(daily: DataFrame, lo: _dt.date, hi: _dt.date) -> DataFrame:
    """D3: every key with a sale in the window x every window day, zeros filled.

    The calendar is generated per key with ``sequence`` (a narrow explode),
    then joined back to the daily sums on the full key."""
    keys = daily.select("sku", "product").distinct()
    cal = keys.select("sku", "product", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("date"))
    return (cal.join(daily, ["sku", "product", "date"], "left")
            .select("sku", "product", "date",
                    *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("qty", "revenue", "profit")]))


def demand_stats(daily: DataFrame, hi: _dt.date, params: PlanParams, scaled: bool = True) -> DataFrame:
    """D4-D7 in closed form per (sku, product)."""
    n = float(params.window_days)
    recent_lo = hi - _dt.timedelta(days=29)
    q = F.col("qty")
    agg = daily.groupBy("sku", "product").agg(
        F.sum(q).alias("s1"),
        F.sum(q * q).alias("s2"),
        F.sum("revenue").alias("rev"),
        F.sum("profit").alias("prof"),
        F.coalesce(F.sum(F.when(F.col("date") >= F.lit(recent_lo), q)), F.lit(0.0)).alias("recent_30d_qty"),
    )
    mean = F.col("s1") / n
    var = (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    mult = F.lit(float(params.demand_multiplier)) if scaled else F.lit(1.0)
    out = agg.select(
        "sku", "product",
        (mean * mult).alias("avg_daily_demand"),
        (std * mult).alias("std_daily_demand"),
        "recent_30d_qty",
        (mean * 365.0).alias("annual_demand_qty"),
        (F.col("rev") / n * 365.0).alias("annual_revenue"),
        (F.col("prof") / n * 365.0).alias("annual_profit"),
    )
    return out.withColumn("forecast_horizon_qty", F.col("avg_daily_demand") * float(params.horizon_days))


def daily_history(sales: DataFrame) -> DataFrame:
    """All-history sums per (sku, product, date): the one aggregate that the
    spike watch, daily series, forecast projection and return rates share."""
    return sales.groupBy("sku", "product", "date").agg(F.sum("qty").alias("qty"))


def daily_series(daily: DataFrame) -> DataFrame:
    """Per SKU and day over all history (pooled over product names).
    ``daily`` is sales or its (sku, product, date) history."""
    return daily.groupBy("sku", "date").agg(F.sum("qty").alias("qty"))


def forecast_projection(sales: DataFrame, first_rows: DataFrame, horizon_days: int) -> DataFrame:
    """For each SKU with history, the days after its last sale with the
    flat forecast and the reorder-point / safety-stock reference lines.

    ``first_rows`` has one planning row per SKU (sku, avg_daily_demand,
    reorder_point, safety_stock)."""
    last = sales.groupBy("sku").agg(F.max("date").alias("last_date"))
    j = last.join(first_rows, "sku")
    return j.select(
        "sku",
        F.explode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", horizon_days))).alias("date"),
        F.col("avg_daily_demand").alias("forecast_qty"),
        "reorder_point",
        "safety_stock",
    )


def demand_spikes(sales: DataFrame, min_days: int = P.SPIKE_MIN_DAYS, keep_last: int = P.SPIKE_KEEP_LAST,
                  daily: DataFrame | None = None) -> DataFrame:
    """IQR / 2-sigma demand spikes over all history.

    Per SKU (products pooled): skip SKUs with fewer than ``min_days`` sale
    days; hit when a day's qty > max(Q3 + 1.5 IQR, mean + 2 std); keep the
    last ``keep_last`` hits in (product, date) order. Groups are daily rows,
    so their size is bounded by the calendar, not by the row count.
    Pass ``daily`` (the shared history aggregate) to skip re-aggregating."""
    daily = daily if daily is not None else daily_history(sales)
    # fences as window aggregates over the same daily rows (one shuffle by
    # sku, no self-join, the daily aggregation runs once)
    per_sku = Window.partitionBy("sku")
    x = daily.select(
        "*",
        F.count(F.lit(1)).over(per_sku).alias("n"),
        F.percentile("qty", F.array(F.lit(0.25), F.lit(0.75))).over(per_sku).alias("qs"),
        F.avg("qty").over(per_sku).alias("mu"),
        F.stddev_samp("qty").over(per_sku).alias("sd"),
    ).where(F.col("n") >= min_days)
    upper = F.col("qs")[1] + (F.col("qs")[1] - F.col("qs")[0]) * P.SPIKE_IQR_FACTOR
    x = x.withColumn("upper", upper).withColumn("two_sigma", F.col("mu") + F.col("sd") * P.SPIKE_SIGMA_FACTOR)
    hits = x.where(F.col("qty") > F.greatest("upper", "two_sigma"))
    w = Window.partitionBy("sku").orderBy(F.col("product").desc(), F.col("date").desc())
    tail = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep_last)
    return tail.select(
        "sku", "product",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.lit("demand_spike").alias("metric"),
        F.col("qty").alias("value"),
        F.greatest(F.col("upper"), F.lit(0.0)).alias("expected_upper"),
        F.when(F.col("qty") < F.col("upper") * P.SPIKE_HIGH_FACTOR, F.lit("Medium")).otherwise(F.lit("High"))
        .alias("severity"),
    )


def seed_inventory(sales: DataFrame, last_n: int = P.SEED_LAST_ROWS, cover_days: int = P.SEED_COVER_DAYS) -> DataFrame:
    """Stock positions seeded from sales when no inventory is given.

    stock = max(0, int(mean qty of the last ``last_n`` sale rows x
    ``cover_days``)); unit_cost = mean line cost. The "last n rows" are the
    latest by date (larger quantities first on a tie). Instead of ranking raw
    rows inside one SKU, rows are first counted per (sku, product, date, qty)
    -- a combinable aggregation that carries the sum and count of the costs --
    and the cut-off is taken on those counts: one read of the sales."""
    keys = ["sku", "product"]
    cnt = sales.groupBy(*keys, "date", "qty").agg(F.count(F.lit(1)).alias("c"), F.sum("cost").alias("cost"), F.count("cost").alias("costs"))
    w = (Window.partitionBy(*keys).orderBy(F.col("date").desc(), F.col("qty").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = cnt.withColumn("_cum", F.sum("c").over(w))
    take = F.least(F.col("c"), F.greatest(F.lit(0), F.lit(last_n) - (F.col("_cum") - F.col("c"))))
    seeds = cum.withColumn("_take", take).groupBy(*keys).agg(
        (F.sum(F.col("_take") * F.col("qty")) / F.sum("_take")).alias("tail_mean"),
        F.try_divide(F.sum("cost"), F.sum("costs")).alias("unit_cost"))
    return seeds.select(
        *keys,
        F.greatest(F.lit(0), F.floor(F.col("tail_mean") * cover_days)).cast("double").alias("stock"),
        "unit_cost",
        F.lit("UNKNOWN").alias("supplier_id"),
        F.lit("Unassigned").alias("warehouse"),
        F.lit(1.0).alias("min_order_qty"),
        F.lit("standard").alias("storage_class"),
    )
