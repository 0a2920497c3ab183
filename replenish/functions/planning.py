"""Planning formulas as Column expressions.

Kept separate from the frame operators so the single run, the scenario grid,
the cost curves and the streaming watch all reuse the same expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Service level -> z steps (a step table, not the normal quantile).
Z_STEPS = ((0.99, 2.33), (0.98, 2.05), (0.95, 1.65), (0.90, 1.28), (0.85, 1.04))
Z_FLOOR = 0.84

# Holding-cost rate by storage class; others use the parameter.
CLASS_HOLDING_RATE = (("fragile", 0.28), ("cold-chain", 0.35))

# PO statuses that no longer bring stock in.
CLOSED_PO_STATUSES = ("closed", "cancelled", "received", "complete", "completed")

# Service levels of the cost curve.
CURVE_SERVICE_LEVELS = (0.80, 0.85, 0.90, 0.95, 0.98, 0.99)

# Return reasons counted as quality returns.
QUALITY_REASONS = ("quality_issue", "damaged")

RISK_DEAD, RISK_CRITICAL, RISK_HIGH, RISK_MEDIUM, RISK_LOW = (
    "Dead-stock risk", "Critical", "High", "Medium", "Low")

# Planning thresholds, weights and rates.
DEFAULT_LEAD_TIME_DAYS = 10.0       # supplier lead time when unknown
DEFAULT_LEAD_TIME_STD_DAYS = 3.0
DEFAULT_ON_TIME_RATE = 0.85
DEFAULT_DEFECT_RATE = 0.02
MIN_ORDER_COST = 0.01               # floor of the order cost in EOQ
MIN_ANNUAL_HOLDING = 0.01           # floor of holding rate x unit cost in EOQ
CRITICAL_COVER_FLOOR_DAYS = 3.0     # Critical: cover <= max(3, 0.35 x lead time)
CRITICAL_COVER_LEAD_SHARE = 0.35
MEDIUM_COVER_EXTRA_DAYS = 7         # Medium: cover <= lead time + 7
DEAD_STOCK_MAX_DEMAND = 0.2         # dead stock: mean daily demand < 0.2 with stock
OVERSTOCK_COVER_DAYS = 90           # overstock: cover > 90 days with stock
ABC_A_SHARE = 0.80                  # running revenue share limits of classes A and B
ABC_B_SHARE = 0.95
SCORE_ON_TIME_WEIGHT = 45           # supplier risk score terms
SCORE_DEFECT_WEIGHT = 250
SCORE_LEAD_CAP_DAYS = 60
SCORE_LEAD_WEIGHT = 25
SCORE_LEAD_STD_CAP_DAYS = 20
SCORE_LEAD_STD_WEIGHT = 15
SCORE_HIGH_RISK_CAP = 5
SCORE_HIGH_RISK_WEIGHT = 3
RISK_BANDS = ((-1, 25, "Low"), (25, 50, "Medium"), (50, 75, "High"), (75, 100, "Critical"))  # (lo, hi]
MCDA_WEIGHTS = (0.3, 0.2, 0.3, 0.2)  # price, speed, reliability, quality
STOCKOUT_PENALTY_MULT = 1.5         # cost curve: penalty = max(1, 1.5 x unit cost)
OCEAN_FREIGHT = (0.08, 0.50)        # unit freight = rate x unit cost + fixed
AIR_FREIGHT = (0.30, 4.00)
AIR_LEAD_SHARE = 0.25               # air lead time = max(3, 0.25 x lead time)
AIR_LEAD_FLOOR_DAYS = 3.0
SPIKE_MIN_DAYS = 10                 # demand spikes: SKUs with >= 10 sale days
SPIKE_IQR_FACTOR = 1.5              # upper fence Q3 + 1.5 IQR
SPIKE_SIGMA_FACTOR = 2              # or mean + 2 std, whichever is higher
SPIKE_HIGH_FACTOR = 1.8             # High when qty >= 1.8 x fence
SPIKE_KEEP_LAST = 5
SEED_LAST_ROWS = 30                 # seeded stock: mean of the last 30 sale rows
SEED_COVER_DAYS = 15                # ... times 15 days
ALERT_CAPS = (40, 20, 20)           # stock-out, supplier, dead-stock alerts


def dround(c: Column, n: int) -> Column:
    """Half-even rounding decided on the value's decimal digits.

    The value first goes through decimal(38,10), which absorbs last-bit
    noise from summation order (partitioning), then rounds half-even, so
    ties such as 27.55 resolve the same way however the sum was formed.
    NaN and infinities pass through."""
    dec = F.bround(c.try_cast("decimal(38,10)"), n).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c).otherwise(F.coalesce(dec, c))


def z_for_service(service_level: float) -> float:
    for level, z in Z_STEPS:
        if service_level >= level:
            return z
    return Z_FLOOR


def z_col(service_level: Column) -> Column:
    expr = F.lit(Z_FLOOR)
    for level, z in reversed(Z_STEPS):
        expr = F.when(service_level >= F.lit(level), F.lit(z)).otherwise(expr)
    return expr


def holding_rate(storage_class: Column, default_rate) -> Column:
    expr = F.lit(default_rate) if not isinstance(default_rate, Column) else default_rate
    for cls, rate in reversed(CLASS_HOLDING_RATE):
        expr = F.when(storage_class == F.lit(cls), F.lit(rate)).otherwise(expr)
    return expr


def safety_stock(z, std: Column, lead_time: Column) -> Column:
    z = z if isinstance(z, Column) else F.lit(z)
    return z * std * F.sqrt(F.greatest(lead_time, F.lit(1.0)))


def reorder_point(avg: Column, lead_time: Column, ss: Column) -> Column:
    return avg * lead_time + ss


def days_of_cover(stock: Column, avg: Column) -> Column:
    return F.when(avg > 0, stock / avg).otherwise(F.lit(INF))


def eoq(annual_demand: Column, unit_cost: Column, holding: Column, order_cost) -> Column:
    oc = order_cost if isinstance(order_cost, Column) else F.lit(max(float(order_cost), MIN_ORDER_COST))
    a = F.greatest(annual_demand, F.lit(0.0))
    uc = F.when(unit_cost == 0, F.lit(1.0)).otherwise(unit_cost)
    ah = F.greatest(holding * uc, F.lit(MIN_ANNUAL_HOLDING))
    return F.sqrt(F.lit(2.0) * a * oc / ah)


def recommended_qty(shortage: Column, eoq_: Column, moq: Column) -> Column:
    first = dround(F.greatest(shortage, F.when(shortage > 0, eoq_).otherwise(F.lit(0.0))), 0)
    return dround(F.greatest(first, F.when(shortage > 0, moq).otherwise(F.lit(0.0))), 0)


def stockout_risk(avg: Column, stock: Column, cover: Column, lead_time: Column,
                  net: Column, rop: Column) -> Column:
    return (
        F.when((avg <= 0) & (stock > 0), F.lit(RISK_DEAD))
        .when(cover <= F.greatest(F.lit(CRITICAL_COVER_FLOOR_DAYS), lead_time * CRITICAL_COVER_LEAD_SHARE),
              F.lit(RISK_CRITICAL))
        .when(net < rop, F.lit(RISK_HIGH))
        .when(cover <= lead_time + MEDIUM_COVER_EXTRA_DAYS, F.lit(RISK_MEDIUM))
        .otherwise(F.lit(RISK_LOW))
    )


def clip(c: Column, lo=None, hi=None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def supplier_risk_score(on_time: Column, defect: Column, lead: Column, lead_std: Column,
                        high_risk: Column) -> Column:
    raw = ((F.lit(1.0) - clip(on_time, 0.0, 1.0)) * SCORE_ON_TIME_WEIGHT
           + clip(defect, 0.0, 1.0) * SCORE_DEFECT_WEIGHT
           + clip(lead, 0.0, float(SCORE_LEAD_CAP_DAYS)) / SCORE_LEAD_CAP_DAYS * SCORE_LEAD_WEIGHT
           + clip(lead_std, 0.0, float(SCORE_LEAD_STD_CAP_DAYS)) / SCORE_LEAD_STD_CAP_DAYS * SCORE_LEAD_STD_WEIGHT
           + F.least(high_risk, F.lit(SCORE_HIGH_RISK_CAP)) * SCORE_HIGH_RISK_WEIGHT)
    return dround(clip(raw, 0.0, 100.0), 1)


def risk_band(score: Column) -> Column:
    """Right-closed bins (-1,25] (25,50] (50,75] (75,100]."""
    expr = F.lit(None).cast("string")
    for lo, hi, label in reversed(RISK_BANDS):
        expr = F.when((score > lo) & (score <= hi), F.lit(label)).otherwise(expr)
    return expr


def inf_to_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None).cast("double")).otherwise(c)
