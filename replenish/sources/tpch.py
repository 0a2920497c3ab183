"""Role views over the star-schema benchmark tables.

Each view maps benchmark columns onto one of the six planning roles, so the
planner runs on whole tables whose size grows with the scale factor. Every
mapping is a projection, an equi-join or an explode of a small per-row array;
nothing is sampled or capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Storage class by part type, warehouse naming, PO status by
# order status, the return-reason cycle, the PO look-back window in days.
STORAGE_BY_TYPE = (("PROMO", "cold-chain"), ("SMALL", "fragile"))
WAREHOUSE_PREFIX = "DC-"
PO_STATUS = (("O", "open"), ("P", "in_transit"), ("F", "received"))
RETURN_REASONS = ("quality_issue", "damaged", "changed_mind", "late_delivery", "wrong_item")
PO_LOOKBACK_DAYS = 60


class Tables:
    """Lazy access to the benchmark parquet files of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


def _sku(c: str) -> Column:
    return F.col(c).cast("string")


def sales(t: Tables, enrich: bool = False) -> DataFrame:
    """Sales lines: lineitem joined to part (product name, list price).

    ``enrich`` adds region / channel / segment through orders, customer,
    nation and region; the planner does not need them, so by default the
    extra joins are left out of the plan."""
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    part = t["part"].select("p_partkey", "p_name", "p_retailprice")
    df = li.join(part, li.l_partkey == part.p_partkey)
    revenue = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.col("l_quantity") * F.col("p_retailprice") / 100
    cols = [
        F.to_date("l_shipdate").alias("date"),
        _sku("l_partkey").alias("sku"),
        F.col("p_name").alias("product"),
        F.col("l_quantity").alias("qty"),
        revenue.alias("revenue"),
        cost.alias("cost"),
        (revenue - cost).alias("profit"),
    ]
    if not enrich:
        return df.select(*cols)
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = t["nation"].select("n_nationkey", "n_regionkey")
    region = t["region"].select("r_regionkey", "r_name")
    df = (df.join(orders, df.l_orderkey == orders.o_orderkey)
          .join(cust, F.col("o_custkey") == cust.c_custkey)
          .join(nation, F.col("c_nationkey") == nation.n_nationkey)
          .join(region, F.col("n_regionkey") == region.r_regionkey))
    return df.select(*cols, F.col("r_name").alias("region"), F.col("o_orderpriority").alias("channel"),
                     F.col("c_mktsegment").alias("segment"))


def sales_daily(t: Tables) -> DataFrame:
    """Daily sales per (sku, product, date) in the standard units.

    Lines are summed per (part, ship day) first -- a combinable aggregation,
    so a part holding a large share of the lines shrinks to one row per day
    per task -- and only then joined to ``part`` for the name and list price;
    line cost is qty x price / 100, so the day's cost is its qty sum times
    the same factor. Negative line quantities count as 0 in the quantity, as
    in the line standardisation, but not in the cost."""
    li = t["lineitem"].select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    revenue = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    day = li.groupBy("l_partkey", F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.greatest(F.col("l_quantity"), F.lit(0.0))).alias("qty"), F.sum("l_quantity").alias("net_qty"),
        F.sum(revenue).alias("revenue"))
    part = t["part"].select("p_partkey", "p_name", "p_retailprice")
    j = day.join(part, day.l_partkey == part.p_partkey)
    cost = F.col("net_qty") * F.col("p_retailprice") / 100
    return j.select(_sku("l_partkey").alias("sku"), F.col("p_name").alias("product"), "date", "qty", "revenue", (F.col("revenue") - cost).alias("profit"))


def storage_class(p_type: Column) -> Column:
    expr = F.lit("standard")
    for typ, cls in reversed(STORAGE_BY_TYPE):
        expr = F.when(p_type == F.lit(typ), F.lit(cls)).otherwise(expr)
    return expr


def inventory(t: Tables) -> DataFrame:
    """Stock positions: each part sits in warehouse 1 + key % 3; every fourth
    part is stocked in all three warehouses (multi-warehouse SKUs)."""
    n_supp = t["supplier"].select(F.count(F.lit(1))).scalar()
    pk = F.col("p_partkey")
    whs = F.when(pk % 4 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1) + pk % 3))
    p = t["part"].select("p_partkey", "p_name", "p_type", "p_retailprice", F.explode(whs).alias("w"))
    w = F.col("w")
    return p.select(
        _sku("p_partkey").alias("sku"),
        F.col("p_name").alias("product"),
        ((pk * 37 + w * 53) % 160).cast("double").alias("stock"),
        (F.col("p_retailprice") / 100).alias("unit_cost"),
        (pk % n_supp).cast("string").alias("supplier_id"),
        F.concat(F.lit(WAREHOUSE_PREFIX), w.cast("string")).alias("warehouse"),
        (F.lit(10) + (pk % 5) * 10).cast("double").alias("min_order_qty"),
        storage_class(F.col("p_type")).alias("storage_class"),
    )


def suppliers(t: Tables) -> DataFrame:
    s = t["supplier"]
    n = t["nation"].select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        _sku("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        (F.lit(3) + k % 26).cast("double").alias("lead_time_days"),
        (F.lit(1) + k % 8).cast("double").alias("lead_time_std_days"),
        (F.lit(0.60) + (k % 40).cast("double") / 100.0).alias("on_time_rate"),
        ((k % 10).cast("double") / 50.0).alias("defect_rate"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("Net "), ((F.lit(1) + k % 4) * 15).cast("string")).alias("payment_terms"),
        (F.lit(300) + (k % 18) * 100).cast("double").alias("min_order_value"),
    )


def purchase_orders(t: Tables) -> DataFrame:
    """Every order line is a purchase order. Orders of the last
    PO_LOOKBACK_DAYS days carry their own status; older ones have long been
    received, so the open-status filter of J3 leaves them out."""
    o = t["orders"].select("o_orderkey", "o_orderstatus", "o_orderdate")
    latest = t["orders"].select(F.max("o_orderdate")).scalar()
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                              "l_extendedprice", "l_shipdate")
    status = F.lit(None).cast("string")
    for code, text in reversed(PO_STATUS):
        status = F.when(F.col("o_orderstatus") == F.lit(code), F.lit(text)).otherwise(status)
    old = F.col("o_orderdate") < latest - F.expr(f"INTERVAL {PO_LOOKBACK_DAYS} DAYS")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("po_id"),
        _sku("l_partkey").alias("sku"),
        _sku("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("ordered_qty"),
        F.when(old, F.lit("received")).otherwise(status).alias("status"),
        F.to_date("o_orderdate").alias("order_date"),
        F.to_date("l_shipdate").alias("expected_date"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("unit_cost"),
    )


def returns(t: Tables) -> DataFrame:
    """Every line flagged returned ('R'); the refund is the discounted unit
    price times the returned units."""
    li = t["lineitem"].where(F.col("l_returnflag") == "R")
    qty = (F.lit(1) + F.col("l_linenumber") % 3).cast("double")
    idx = (F.col("l_partkey") + F.col("l_orderkey")) % len(RETURN_REASONS)
    reason = F.lit(RETURN_REASONS[-1])
    for i in reversed(range(len(RETURN_REASONS) - 1)):
        reason = F.when(idx == i, F.lit(RETURN_REASONS[i])).otherwise(reason)
    return li.select(
        F.date_add(F.to_date("l_shipdate"), 7).alias("date"),
        _sku("l_partkey").alias("sku"),
        qty.alias("return_qty"),
        reason.alias("reason"),
        (qty * (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) / F.col("l_quantity"))).alias("refund_amount"),
    )


def bom(t: Tables) -> DataFrame:
    """Recipes derived from part size: large parts (size > 45) are assemblies
    of the next two parts (1 + key % 3 units and 12 units); small parts
    (size <= 5) are kits holding 2 units of part key + 3, which makes some
    chains two levels deep. A component must exist in ``part``."""
    pk = F.col("p_partkey")
    rec = lambda off, qty: F.struct((pk + off).alias("comp"), qty.cast("double").alias("qty"))
    recipes = (F.when(F.col("p_size") > 45, F.array(rec(1, F.lit(1) + pk % 3), rec(2, F.lit(12))))
               .when(F.col("p_size") <= 5, F.array(rec(3, F.lit(2)))))
    r = (t["part"].where((F.col("p_size") > 45) | (F.col("p_size") <= 5))
         .select("p_partkey", F.explode(recipes).alias("r"))
         .select("p_partkey", F.col("r.comp").alias("comp"), F.col("r.qty").alias("qty_required")))
    comp = t["part"].select(F.col("p_partkey").alias("c_key"), F.col("p_name").alias("c_name"))
    return r.join(comp, r.comp == comp.c_key).select(
        _sku("p_partkey").alias("parent_sku"),
        _sku("c_key").alias("component_sku"),
        F.col("c_name").alias("component_name"),
        F.col("qty_required"),
    )


def utc_instant(ts: Column) -> Column:
    """A wall-clock timestamp (no zone) read as UTC, whatever the session
    time zone; an event-time column for watermarks and day windows."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def utc_date(instant: Column) -> Column:
    """The UTC calendar date of an instant, whatever the session time zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant))


def purchase_events(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_type") == "purchase").select(
        utc_instant(F.col("ts")).alias("ts"),
        F.col("user_id").cast("string").alias("sku"),
        F.get_json_object("props", "$.k").try_cast("double").alias("qty"),
    )


def role_tables(t: Tables) -> dict[str, DataFrame]:
    return {
        "sales": sales(t),
        "inventory": inventory(t),
        "suppliers": suppliers(t),
        "purchase_orders": purchase_orders(t),
        "returns": returns(t),
        "bom": bom(t),
    }
