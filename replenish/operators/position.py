"""Stock position: stock x demand, BOM dependent demand, suppliers, incoming
(J1-J8, B1-B6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish import schemas
from replenish.functions import planning as P
from replenish.functions.planning import CLOSED_PO_STATUSES, dround

DEMAND_COLS = ("avg_daily_demand", "std_daily_demand", "forecast_horizon_qty", "annual_demand_qty")

# Fill values of the stock x demand outer join.
BASE_FILL = {"stock": 0.0, "unit_cost": 0.0, "supplier_id": "UNKNOWN", "warehouse": "Unassigned",
             "min_order_qty": 1.0, "storage_class": "standard", "avg_daily_demand": 0.0,
             "std_daily_demand": 0.0, "forecast_horizon_qty": 0.0, "annual_demand_qty": 0.0,
             "annual_revenue": 0.0, "annual_profit": 0.0}

# Demo recipes (parent, component, component name, qty) and
# demo component stock (sku, stock, unit cost, supplier, warehouse, MOQ,
# storage class), used only with PlanParams.demo_bom.
DEMO_BOM = (
    ("SKU-001", "COMP-001", "Premium Glass Bottle", 1.0),
    ("SKU-001", "COMP-002", "Leakproof Cap w/ Seal", 1.0),
    ("SKU-001", "COMP-003", "Silicone Straw & Cap Attachment", 1.0),
    ("SKU-002", "COMP-004", "Foil Protein Bar Wrapper", 12.0),
    ("SKU-002", "COMP-005", "Corrugated Display Carton Box", 1.0),
    ("SKU-003", "COMP-006", "Nylon Mat Carrying Strap", 1.0),
    ("SKU-003", "COMP-007", "Eco-friendly TPE Mat Roll (Purple)", 1.0),
)
DEMO_COMPONENT_STOCK = (
    ("COMP-001", 45.0, 1.20, "SUP-01", "Bengaluru DC", 500.0, "fragile"),
    ("COMP-002", 120.0, 0.30, "SUP-01", "Bengaluru DC", 1000.0, "standard"),
    ("COMP-003", 15.0, 0.45, "SUP-03", "Bengaluru DC", 500.0, "standard"),
    ("COMP-004", 2500.0, 0.08, "SUP-02", "Mumbai DC", 10000.0, "standard"),
    ("COMP-005", 80.0, 0.50, "SUP-02", "Mumbai DC", 1000.0, "standard"),
    ("COMP-006", 35.0, 0.80, "SUP-03", "Mumbai DC", 500.0, "standard"),
    ("COMP-007", 8.0, 4.50, "SUP-03", "Mumbai DC", 200.0, "cold-chain"),
)


def demo_bom(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEMO_BOM), schemas.BOM)


def demo_component_stock(spark: SparkSession) -> DataFrame:
    names = {r[1]: r[2] for r in DEMO_BOM}
    rows = [(s, names[s], st, uc, sup, wh, moq, cls) for s, st, uc, sup, wh, moq, cls in DEMO_COMPONENT_STOCK]
    return spark.createDataFrame(rows, schemas.INVENTORY)


def add_demo_components(inv: DataFrame) -> DataFrame:
    """Add demo component rows whose sku is not stocked yet."""
    comp = demo_component_stock(inv.sparkSession)
    return inv.unionByName(comp.join(inv.select("sku").distinct(), "sku", "left_anti"))


def seed_suppliers(inv: DataFrame) -> DataFrame:
    """One default supplier row per supplier id found in stock."""
    ids = inv.select(F.coalesce(F.col("supplier_id"), F.lit("UNKNOWN")).alias("supplier_id")).distinct()
    return ids.select(
        "supplier_id",
        F.col("supplier_id").alias("supplier_name"),
        F.lit(P.DEFAULT_LEAD_TIME_DAYS).alias("lead_time_days"),
        F.lit(P.DEFAULT_LEAD_TIME_STD_DAYS).alias("lead_time_std_days"),
        F.lit(P.DEFAULT_ON_TIME_RATE).alias("on_time_rate"),
        F.lit(P.DEFAULT_DEFECT_RATE).alias("defect_rate"),
        F.lit("Unknown").alias("country"),
        F.lit("Unknown").alias("payment_terms"),
        F.lit(0.0).alias("min_order_value"),
    )


def stock_demand(inv: DataFrame, stats: DataFrame) -> DataFrame:
    """All stock rows and all demand rows, matched on (sku, product),
    with the documented fills.

    A left join plus the demand rows without stock, rather than one full
    outer join: adaptive execution can split a left join's hot key (a SKU
    with a large share of the stock rows), a full outer join's it can't."""
    keys = ["sku", "product"]
    matched = inv.join(stats, keys, "left")
    only_demand = stats.join(inv.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(only_demand, allowMissingColumns=True).fillna(BASE_FILL)


def dependent_demand(base: DataFrame, bom: DataFrame) -> DataFrame:
    """B2: per component, sum over its recipe rows of (parent demand summed
    over the parent's stock rows) x qty_required. Every component of the BOM
    gets a row (0 when no parent has demand)."""
    parent = base.groupBy(F.col("sku").alias("parent_sku")).agg(
        *[F.sum(c).alias(f"p_{c}") for c in DEMAND_COLS])
    rec = bom.where(F.col("parent_sku").isNotNull() & F.col("component_sku").isNotNull())
    j = rec.join(parent, "parent_sku", "left")
    return j.groupBy("component_sku").agg(
        *[F.sum(F.coalesce(F.col(f"p_{c}"), F.lit(0.0)) * F.col("qty_required")).alias(f"dep_{c}")
          for c in DEMAND_COLS])


def apply_bom(base: DataFrame, bom: DataFrame, levels: int = 1) -> DataFrame:
    """B1 + B3: components take dependent demand instead of their own.

    ``levels=1`` uses the parents' own (pre-override) demand, as the original
    does; more levels re-run the propagation on the overridden demand;
    ``levels=0`` takes all levels there are (recipes in a cycle raise)."""
    if levels == 0:
        from replenish.operators.bom import multilevel_demand
        return _overridden(base, multilevel_demand(base, bom).drop("low_level_code"))
    cur = base
    for _ in range(max(1, levels)):
        out = _overridden(base, dependent_demand(cur, bom).withColumnRenamed("component_sku", "sku"))
        cur = out.select(base.columns)
    return out


def _overridden(base: DataFrame, dep: DataFrame) -> DataFrame:
    """Planning rows whose components take the demand of ``dep`` (sku, dep_...)."""
    is_comp = F.col("dep_avg_daily_demand").isNotNull()
    cols = [c for c in base.columns if c not in DEMAND_COLS]
    dependent = lambda c, name: F.coalesce(F.col(f"dep_{c}"), F.lit(0.0)).alias(name)
    return base.join(dep, "sku", "left").select(
        *cols,
        *[F.when(is_comp, F.col(f"dep_{c}")).otherwise(F.col(c)).alias(c) for c in DEMAND_COLS],
        is_comp.alias("is_component"),
        *[dependent(c, {"forecast_horizon_qty": "component_forecast_qty", "annual_demand_qty": "component_annual_demand"}.get(c, f"component_{c}"))
          for c in DEMAND_COLS],
    )


def with_suppliers(base: DataFrame, suppliers: DataFrame, delay_days: float = 0.0) -> DataFrame:
    """J2 + R3: supplier attributes (left join, duplicates kept as in the
    original) and lead time = coalesce(lead, 10) + delay. Whether the
    supplier side is broadcast is left to adaptive execution, which decides
    by its bytes."""
    sup = suppliers.select("supplier_id", "supplier_name", "lead_time_days", "lead_time_std_days",
                           "on_time_rate", "defect_rate", "country", "payment_terms", "min_order_value")
    j = base.join(sup, "supplier_id", "left")
    return (j.withColumn("lead_time_days", F.coalesce("lead_time_days", F.lit(P.DEFAULT_LEAD_TIME_DAYS))
                         + F.lit(float(delay_days)))
            .withColumn("lead_time_std_days", F.coalesce("lead_time_std_days", F.lit(P.DEFAULT_LEAD_TIME_STD_DAYS)))
            .withColumn("on_time_rate", F.coalesce("on_time_rate", F.lit(P.DEFAULT_ON_TIME_RATE)))
            .withColumn("defect_rate", F.coalesce("defect_rate", F.lit(P.DEFAULT_DEFECT_RATE))))


def open_po_filter(pos: DataFrame) -> DataFrame:
    """Statuses that still bring stock in (delayed / in_transit count)."""
    return pos.where(~F.col("status").isin(*CLOSED_PO_STATUSES))


def incoming(pos: DataFrame) -> DataFrame:
    """Per sku, open quantity and earliest expected date."""
    return open_po_filter(pos).groupBy("sku").agg(
        F.sum("ordered_qty").alias("incoming_qty"), F.min("expected_date").alias("next_eta"))


def with_incoming(base: DataFrame, pos: DataFrame) -> DataFrame:
    j = base.join(incoming(pos), "sku", "left")
    return j.withColumn("incoming_qty", F.coalesce("incoming_qty", F.lit(0.0)))


def first_per_key(df: DataFrame, keys: list[str], order: list, cols: list[str]) -> DataFrame:
    """The first row per key under ``order`` as a combinable aggregation
    (min_by over a struct), so a hot key is reduced map-side."""
    ordkey = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), ordkey).alias("_r")).select(*keys, "_r.*")


def bom_explosion(bom: DataFrame, health: DataFrame, parent_first: DataFrame) -> DataFrame:
    """Per recipe row, units needed for the parent's horizon forecast and
    the shortage against each stock row of the component."""
    comp = health.select(F.col("sku").alias("component_sku"), F.col("product").alias("comp_name_inv"),
                         F.col("warehouse").alias("component_warehouse"), "stock", "reorder_point",
                         "recommended_order_qty")
    par = parent_first.select(F.col("sku").alias("parent_sku"), F.col("forecast_horizon_qty").alias("parent_forecast"))
    j = bom.join(par, "parent_sku").join(comp, "component_sku", "left")
    required = dround(F.col("qty_required") * F.col("parent_forecast"), 1)
    stock = F.coalesce("stock", F.lit(0.0))
    return j.select(
        "parent_sku", "component_sku", "component_name", "qty_required", "component_warehouse",
        stock.alias("stock"),
        required.alias("required_for_forecast"),
        dround(F.greatest(required - stock, F.lit(0.0)), 1).alias("shortage_for_forecast"),
    )
