"""Query catalogue: name -> f(spark, sf_dir) -> DataFrame over the benchmark
tables (role views in ``replenish.sources.tpch``).

Every query runs over whole tables. Doubles are rounded half-even at the end
(4 decimals by default, 2 for money totals whose last bits depend on the
summation order) so that results compare exactly against the oracle."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.functions.planning import ALERT_CAPS, dround
from replenish.params import PlanParams
from replenish.plans.model import SupplyModel
from replenish.sources import tpch

PARAMS = PlanParams(match="exact")
_MODELS: dict = {}


def round_half_even(c, n: int):
    """Output rounding (see ``replenish.functions.planning.dround``)."""
    return dround(c, n)


def finalize(df: DataFrame, decimals: int = 4, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column half-even (``overrides`` per column)."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_even(F.col(f.name), overrides.get(f.name, decimals)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def tables(spark: SparkSession, sf_dir: str) -> tpch.Tables:
    return tpch.Tables(spark, sf_dir)


def model(spark: SparkSession, sf_dir: str, params: PlanParams = PARAMS) -> SupplyModel:
    """Planning model over the role views (cached per session and folder)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), params)
    if key not in _MODELS:
        t = tables(spark, sf_dir)
        # latest ship date straight from lineitem (one column); every line's
        # part exists in ``part``, so it equals the latest sale date
        anchor = t["lineitem"].select(F.max("l_shipdate")).first()[0]
        anchor = anchor.date() if isinstance(anchor, _dt.datetime) else anchor
        _MODELS[key] = SupplyModel(spark, tpch.role_tables(t), params, anchor=anchor, seed=False,
                                   sales_daily=tpch.sales_daily(t)).materialize()
    return _MODELS[key]


# x/90*365 of 4-decimal sums hits exact 4th-decimal ties; at 6 decimals the
# exact values stay >= 5e-8 away from a tie, far above summation noise.
ANNUAL_MONEY = {"annual_revenue": 6, "annual_profit": 6}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---- standardisation (N9-N16) -------------------------------------------
@query("std_sales")
def std_sales(spark, sf_dir):
    from replenish.operators.standardize import standardize_sales
    s = standardize_sales(tpch.sales(tables(spark, sf_dir), enrich=True), match="exact")
    out = s.groupBy("region", "channel", "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"),
        F.sum("cost").alias("cost"), F.sum("profit").alias("profit"))
    return finalize(out)


def _role(spark, sf_dir, role: str, view) -> DataFrame:
    """One standardised role, read from its own view only."""
    from replenish.operators.standardize import standardize
    return finalize(standardize(role, view(tables(spark, sf_dir)), spark, match="exact"))


@query("std_inventory")
def std_inventory(spark, sf_dir):
    return _role(spark, sf_dir, "inventory", tpch.inventory)


@query("std_suppliers")
def std_suppliers(spark, sf_dir):
    return _role(spark, sf_dir, "suppliers", tpch.suppliers)


@query("std_pos")
def std_pos(spark, sf_dir):
    return _role(spark, sf_dir, "purchase_orders", tpch.purchase_orders)


@query("std_returns")
def std_returns(spark, sf_dir):
    return _role(spark, sf_dir, "returns", tpch.returns)


@query("std_bom")
def std_bom(spark, sf_dir):
    return _role(spark, sf_dir, "bom", tpch.bom)


# ---- demand (D1-D12) ----------------------------------------------------
@query("demand_daily")
def demand_daily(spark, sf_dir):
    return finalize(model(spark, sf_dir).daily)


@query("demand_dense_calendar")
def demand_dense_calendar(spark, sf_dir):
    return finalize(model(spark, sf_dir).dense_calendar())


@query("demand_stats")
def demand_stats(spark, sf_dir):
    return finalize(model(spark, sf_dir).stats(), 4, ANNUAL_MONEY)


# ---- position and reorder (J, R) ---------------------------------------
BASE_POSITION_COLS = ["sku", "product", "warehouse", "stock", "unit_cost", "supplier_id", "supplier_name",
                      "min_order_qty", "storage_class", "avg_daily_demand", "std_daily_demand", "recent_30d_qty",
                      "annual_demand_qty", "annual_revenue", "annual_profit", "forecast_horizon_qty",
                      "is_component", "lead_time_days", "lead_time_std_days", "on_time_rate", "defect_rate",
                      "incoming_qty", "next_eta"]


@query("base_position")
def base_position(spark, sf_dir):
    return finalize(model(spark, sf_dir).position().select(*BASE_POSITION_COLS), 4, ANNUAL_MONEY)


REORDER_MATH_COLS = ["sku", "product", "warehouse", "holding_cost_rate", "safety_stock", "reorder_point",
                     "days_of_cover", "net_position", "shortage_qty", "eoq", "recommended_order_qty",
                     "inventory_value", "recommended_order_value", "stockout_risk", "dead_stock_flag",
                     "overstock_flag"]


@query("reorder_math")
def reorder_math(spark, sf_dir):
    return finalize(model(spark, sf_dir).base.select(*REORDER_MATH_COLS))


@query("reorder_plan")
def reorder_plan(spark, sf_dir):
    from replenish.operators.reorder import REORDER_PLAN_COLS
    return finalize(model(spark, sf_dir).reorder_plan().select(*REORDER_PLAN_COLS, "warehouse"))


HEALTH_COLS = ["sku", "product", "warehouse", "stock", "avg_daily_demand", "days_of_cover", "inventory_value",
               "stockout_risk", "dead_stock_flag", "overstock_flag", "cum_revenue_pct", "abc_class"]


@query("inventory_health")
def inventory_health(spark, sf_dir):
    return finalize(model(spark, sf_dir).health.select(*HEALTH_COLS), 4, {"cum_revenue_pct": 6})


@query("demand_forecast_top20")
def demand_forecast_top20(spark, sf_dir):
    h = model(spark, sf_dir).base
    top = h.orderBy(F.col("forecast_horizon_qty").desc(), "sku", "product", "warehouse").limit(20)
    return finalize(top.select("sku", "product", "warehouse", "forecast_horizon_qty", "avg_daily_demand",
                               "stockout_risk"))


@query("forecast_projection")
def forecast_projection(spark, sf_dir):
    from replenish.operators.demand import forecast_projection as fp
    m = model(spark, sf_dir)
    return finalize(fp(m.history, m.first_rows(), m.params.horizon_days))


@query("demand_spikes")
def demand_spikes(spark, sf_dir):
    from replenish.operators.demand import demand_spikes as ds
    m = model(spark, sf_dir)
    return finalize(ds(m.sales, daily=m.history))


@query("seed_inventory_from_sales")
def seed_inventory_from_sales(spark, sf_dir):
    from replenish.operators.demand import seed_inventory
    return finalize(seed_inventory(model(spark, sf_dir).sales))


@query("seed_suppliers")
def seed_suppliers(spark, sf_dir):
    from replenish.operators.position import seed_suppliers as ss
    return finalize(ss(model(spark, sf_dir).inventory))


# ---- bill of materials (B1-B6) -------------------------------------------
@query("bom_dependent_demand")
def bom_dependent_demand(spark, sf_dir):
    from replenish.operators.position import dependent_demand, stock_demand
    m = model(spark, sf_dir)
    return finalize(dependent_demand(stock_demand(m.inventory, m.stats()), m.bom))


@query("bom_multilevel_demand")
def bom_multilevel_demand(spark, sf_dir):
    from replenish.operators.bom import multilevel_demand
    from replenish.operators.position import stock_demand
    m = model(spark, sf_dir)
    return finalize(multilevel_demand(stock_demand(m.inventory, m.stats()), m.bom))


@query("bom_explosion")
def bom_explosion(spark, sf_dir):
    from replenish.operators.position import bom_explosion as be
    m = model(spark, sf_dir)
    return finalize(be(m.bom, m.base, m.first_rows()))


@query("bom_component_plan")
def bom_component_plan(spark, sf_dir):
    m = model(spark, sf_dir)
    comp = m.base.join(m.bom.select(F.col("component_sku").alias("sku")), "sku", "left_semi")
    return finalize(comp.select("sku", "product", "warehouse", "stock", "avg_daily_demand", "reorder_point",
                                "recommended_order_qty", "recommended_order_value", "stockout_risk"))


# ---- reorder listings (R12-R20) ------------------------------------------
@query("calc_breakdown")
def calc_breakdown(spark, sf_dir):
    from replenish.operators.reorder import calc_breakdown as cb
    m = model(spark, sf_dir)
    return finalize(cb(m.base, m.params))


@query("risk_distribution")
def risk_distribution(spark, sf_dir):
    from replenish.operators.reorder import risk_distribution as rd
    return rd(model(spark, sf_dir).base)


@query("dead_overstock")
def dead_overstock(spark, sf_dir):
    b = model(spark, sf_dir).base
    return finalize(b.where(F.col("dead_stock_flag") | F.col("overstock_flag")).select(
        "sku", "product", "warehouse", "stock", "days_of_cover", "dead_stock_flag", "overstock_flag"))


@query("abc_classes")
def abc_classes(spark, sf_dir):
    h = model(spark, sf_dir).health
    out = h.groupBy("abc_class").agg(F.count(F.lit(1)).alias("rows"), F.sum("annual_revenue").alias("annual_revenue"),
                                     F.max("cum_revenue_pct").alias("max_cum_revenue_pct"))
    return finalize(out, 6, {"annual_revenue": 1})


@query("inventory_map")
def inventory_map(spark, sf_dir):
    from replenish.functions.planning import inf_to_null
    b = model(spark, sf_dir).base
    return finalize(b.select("sku", "product", "warehouse", inf_to_null(F.col("days_of_cover")).alias("days_of_cover"),
                             "inventory_value", "stock", "stockout_risk"))


# ---- suppliers (P1-P7) ----------------------------------------------------
@query("supplier_risk")
def supplier_risk(spark, sf_dir):
    return finalize(model(spark, sf_dir).supplier_risk())


@query("supplier_mcda")
def supplier_mcda(spark, sf_dir):
    from replenish.operators.suppliers import mcda
    r = mcda(model(spark, sf_dir).supplier_risk())
    return finalize(r.select("supplier_id", "supplier_name", "mcda_score", "score_price", "score_speed",
                             "score_reliability", "score_quality", "avg_unit_cost", "avg_lead_time",
                             "avg_on_time_rate", "avg_defect_rate", "risk_level"))


# ---- returns (T1-T7) ------------------------------------------------------
@query("returns_totals")
def returns_totals(spark, sf_dir):
    from replenish.operators.returns import totals
    return finalize(totals(model(spark, sf_dir).returns))


@query("returns_by_reason")
def returns_by_reason(spark, sf_dir):
    from replenish.operators.returns import by_reason
    return finalize(by_reason(model(spark, sf_dir).returns))


@query("sku_return_rate")
def sku_return_rate(spark, sf_dir):
    return finalize(model(spark, sf_dir).sku_returns(), 6)


@query("supplier_returns")
def supplier_returns(spark, sf_dir):
    from replenish.operators.returns import defect_correlation
    m = model(spark, sf_dir)
    return finalize(defect_correlation(m.supplier_returns(), m.supplier_risk()), 6)


@query("overall_return_rate")
def overall_return_rate(spark, sf_dir):
    from replenish.operators.returns import overall_return_rate as orr
    m = model(spark, sf_dir)
    return finalize(orr(m.returns, m.history), 8)


# ---- transfers (X1-X5) ----------------------------------------------------
@query("transfers_whole_units")
def transfers_whole_units(spark, sf_dir):
    return finalize(model(spark, sf_dir).whole_transfers)


@query("transfers_exact")
def transfers_exact(spark, sf_dir):
    return finalize(model(spark, sf_dir).transfers)


@query("top_transfers")
def top_transfers(spark, sf_dir):
    """The 15 transfers that save most."""
    from replenish.operators.transfers import top_transfers as tt
    return finalize(tt(model(spark, sf_dir).transfers))


@query("transfer_summary")
def transfer_summary(spark, sf_dir):
    from replenish.operators.transfers import transfer_summary as ts
    return finalize(ts(model(spark, sf_dir).transfers), 2, GRID_MONEY)


# ---- economics (O, F, V) --------------------------------------------------
@query("cost_curves")
def cost_curves(spark, sf_dir):
    return finalize(model(spark, sf_dir).cost_curves(), 2)


@query("optimal_service_level")
def optimal_service_level(spark, sf_dir):
    from replenish.operators.economics import optimal_service_level as osl
    return finalize(osl(model(spark, sf_dir).cost_curves()), 2)


@query("freight_modes")
def freight_modes(spark, sf_dir):
    return finalize(model(spark, sf_dir).freight())


@query("freight_portfolio")
def freight_portfolio(spark, sf_dir):
    from replenish.operators.economics import freight_portfolio as fp
    return finalize(fp(model(spark, sf_dir).freight()), 2)


@query("freight_long")
def freight_long(spark, sf_dir):
    from replenish.operators.economics import freight_long as fl
    return finalize(fl(model(spark, sf_dir).freight()))


@query("financial_velocity")
def financial_velocity(spark, sf_dir):
    return finalize(model(spark, sf_dir).finance())


@query("finance_by_class")
def finance_by_class(spark, sf_dir):
    from replenish.operators.economics import finance_by_class as fc
    return finalize(fc(model(spark, sf_dir).finance()), 3)


@query("portfolio_ratios")
def portfolio_ratios(spark, sf_dir):
    from replenish.operators.economics import portfolio_ratios as pr
    return finalize(pr(model(spark, sf_dir).finance()), 3)


@query("kpis")
def kpis(spark, sf_dir):
    from replenish.operators.outputs import kpis as kp
    m = model(spark, sf_dir)
    k = kp(m.base, m.supplier_risk(), m.returns, m.transfers, m.finance(),
           m.params.horizon_days, m.params.service_level)
    return finalize(k, 2, GRID_MONEY)


# ---- alerts and documents (A2-A6, G1-G3) ----------------------------------
def _alert_queue(m: SupplyModel, caps=None) -> DataFrame:
    from replenish.operators.outputs import alerts
    return alerts(m.base, m.supplier_risk(), m.transfers, caps or m.params.alert_caps)


@query("alerts")
def alerts_q(spark, sf_dir):
    """A2-A5: the whole queue."""
    return _alert_queue(model(spark, sf_dir))


@query("alerts_top")
def alerts_top(spark, sf_dir):
    """A2-A5 as the original's short queue: 40 / 20 / 20 rows."""
    return _alert_queue(model(spark, sf_dir), ALERT_CAPS)


@query("procurement_draft_lines")
def procurement_draft_lines(spark, sf_dir):
    """G1: every plan row as a draft line, ranked within its supplier."""
    from replenish.operators.outputs import draft_lines
    return draft_lines(model(spark, sf_dir).base.where(F.col("recommended_order_qty") > 0))


@query("procurement_drafts")
def procurement_drafts(spark, sf_dir):
    from replenish.operators.outputs import procurement_drafts as pd_
    m = model(spark, sf_dir)
    return pd_(m.base.where(F.col("recommended_order_qty") > 0))


@query("rfq_drafts")
def rfq_drafts(spark, sf_dir):
    from replenish.operators.outputs import rfq_drafts as rd
    m = model(spark, sf_dir)
    return rd(m.first_rows(), F.date_add(F.lit(m.window[1]), 20))


@query("report_lines")
def report_lines(spark, sf_dir):
    from replenish.operators.outputs import kpis as kp
    from replenish.operators.outputs import report_lines as rl
    m = model(spark, sf_dir)
    tr = m.transfers
    k = kp(m.base, m.supplier_risk(), m.returns, tr, m.finance(), m.params.horizon_days, m.params.service_level)
    plan = m.base.where(F.col("recommended_order_qty") > 0)
    return rl(k, plan, m.supplier_risk(), _alert_queue(m, ALERT_CAPS))


# ---- scenarios (W1-W3) ----------------------------------------------------
def _scenarios(spark, sf_dir):
    from replenish.operators.scenarios import grid, scenario_rows, scenario_summary
    m = model(spark, sf_dir)
    return scenario_summary(scenario_rows(m.position(scaled=False), grid(), m.params))


# Sums of (units x 3-decimal unit cost) lie exactly on a 0.001 grid: rounding
# them to 2 decimals would land on exact ties that summation order decides,
# so they keep 3 or more decimals.
GRID_MONEY = {"total_inventory_value": 3, "recommended_order_value": 3, "saved_transfer_value": 3}


@query("scenario_grid")
def scenario_grid(spark, sf_dir):
    return finalize(_scenarios(spark, sf_dir), 2, GRID_MONEY)


@query("scenario_long")
def scenario_long(spark, sf_dir):
    from replenish.operators.scenarios import scenario_long as sl
    return finalize(sl(_scenarios(spark, sf_dir)), 3)


# ---- playbook watches (E1-E5) --------------------------------------------
@query("stockout_watch")
def stockout_watch(spark, sf_dir):
    from replenish.operators.watch import stockout_watch as sw
    return finalize(sw(model(spark, sf_dir).base))


@query("supplier_delay_watch")
def supplier_delay_watch(spark, sf_dir):
    from replenish.operators.watch import supplier_delay_watch as sdw
    m = model(spark, sf_dir)
    return finalize(sdw(m.purchase_orders, m.supplier_risk(), F.lit(m.window[1])))


@query("dead_stock_cleanup")
def dead_stock_cleanup(spark, sf_dir):
    from replenish.operators.watch import dead_stock_cleanup as dsc
    return finalize(dsc(model(spark, sf_dir).base))


MONTHLY_BUDGET = 5000.0


@query("budget_guardrail")
def budget_guardrail(spark, sf_dir):
    from replenish.operators.watch import budget_guardrail as bg
    m = model(spark, sf_dir)
    return finalize(bg(m.base.where(F.col("recommended_order_qty") > 0), MONTHLY_BUDGET))


@query("playbook_table")
def playbook_table(spark, sf_dir):
    """The five playbooks with the rows each flags now."""
    from replenish.operators.demand import demand_spikes as spikes
    from replenish.operators.playbooks import playbook_table as pt
    from replenish.operators.position import open_po_filter
    from replenish.operators.watch import budget_guardrail as bg
    m = model(spark, sf_dir)
    orders = open_po_filter(m.purchase_orders).join(m.supplier_risk().select("supplier_id", "supplier_risk_score"), "supplier_id", "left")
    results = {"positions": m.base, "open_orders": orders, "spikes": spikes(m.sales, daily=m.history),
               "budget": bg(m.base.where(F.col("recommended_order_qty") > 0), MONTHLY_BUDGET)}
    return pt(results, as_of=m.window[1], monthly_budget=MONTHLY_BUDGET)


@query("scenario_upsert")
def scenario_upsert(spark, sf_dir):
    """The scenario grid saved, then its delayed scenarios saved again with another count."""
    from replenish.operators.scenarios import ScenarioStore
    from replenish.session import scratch_path
    store = ScenarioStore(spark, scratch_path(spark, "scenarios"))
    store.save(_scenarios(spark, sf_dir))
    saved = store.read()
    store.save(saved.where(F.col("lead_time_delay") > 0).withColumn("critical_skus", F.col("critical_skus") + 1000))
    return finalize(store.read(), 2, GRID_MONEY)


# ---- written tables read back (K1-K3, S1, S3) ------------------------------
def _round_trip(spark, sf_dir, fmt: str, roles: dict) -> dict[str, DataFrame]:
    """Standardised roles written in one format, with a manifest, and read back under their own types."""
    from replenish.operators.standardize import standardize
    from replenish.session import scratch_path
    from replenish.sinks.export import read_tables, write_tables
    t = tables(spark, sf_dir)
    made = {role: standardize(role, view(t), spark, match="exact") for role, view in roles.items()}
    path = scratch_path(spark, f"round-trip-{fmt}")
    write_tables(made, path, fmt)
    back = read_tables(spark, path)
    return {role: finalize(back[role].select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])) for role, df in made.items()}


@query("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "csv", {"inventory": tpch.inventory})["inventory"]


@query("json_roundtrip")
def json_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json", {"purchase_orders": tpch.purchase_orders})["purchase_orders"]


@query("bundle_roundtrip")
def bundle_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "parquet", {"suppliers": tpch.suppliers, "bom": tpch.bom})["suppliers"]


@query("folder_roundtrip")
def folder_roundtrip(spark, sf_dir):
    """Tables written as header CSV; the folder is loaded, roles are found by name, the stock standardised."""
    from replenish.operators.standardize import standardize
    from replenish.session import scratch_path
    from replenish.sinks.export import write_csv
    from replenish.sources.files import load_dir
    from replenish.sources.workspace import Workspace
    t = tables(spark, sf_dir)
    path = scratch_path(spark, "folder")
    for role, view in {"inventory": tpch.inventory, "suppliers": tpch.suppliers, "bom": tpch.bom}.items():
        write_csv(standardize(role, view(t), spark, match="exact"), f"{path}/{role}.csv")
    found = Workspace(spark).update(load_dir(spark, path)).role_tables()
    return finalize(standardize("inventory", found["inventory"], spark, match="exact"))


@query("audit_roundtrip")
def audit_roundtrip(spark, sf_dir):
    """K2: the reorder plan as written for the audit, read back under its own types."""
    from replenish.session import scratch_path
    from replenish.sinks.export import json_safe, write_audit
    plan = reorder_plan(spark, sf_dir)
    path = scratch_path(spark, "audit")
    write_audit({"reorder_plan": plan}, path)
    return spark.read.schema(json_safe(plan).schema).json(f"{path}/reorder_plan")


@query("automation_payload")
def automation_payload_q(spark, sf_dir):
    """K4: the alerts of the payload, parsed back from its JSON."""
    from replenish.operators.outputs import playbooks
    from replenish.sinks.export import automation_payload
    queue = _alert_queue(model(spark, sf_dir))
    payload = automation_payload(playbooks(spark), queue, "transfers")
    alert = f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in queue.schema.fields)}>>"
    parsed = payload.select(F.from_json("payload", f"alerts {alert}").alias("p"))
    return parsed.select(F.explode("p.alerts").alias("a")).select("a.*")


@query("report_text")
def report_text(spark, sf_dir):
    """K5: the lines of the report's text file."""
    from replenish.session import scratch_path
    from replenish.sinks.export import write_report
    path = scratch_path(spark, "report")
    write_report(report_lines(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("text"))


# ---- fallbacks (N16, D8) ---------------------------------------------------
@query("price_fallback_sales")
def price_fallback_sales(spark, sf_dir):
    """Sales without a revenue column take quantity x price."""
    from replenish.operators.standardize import standardize_sales
    t = tables(spark, sf_dir)
    lines = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").alias("date"), F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("product"),
        F.col("l_quantity").alias("quantity"), F.col("p_retailprice").alias("unit_price"))
    s = standardize_sales(lines, match="exact")
    return finalize(s.groupBy("sku", "product").agg(F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("rows")))


@query("no_sales_position")
def no_sales_position(spark, sf_dir):
    """Without sales every stock row keeps its place with no demand."""
    t = tables(spark, sf_dir)
    m = SupplyModel(spark, {**tpch.role_tables(t), "sales": None, "bom": None}, PARAMS, seed=False)
    return finalize(m.position().select("sku", "product", "warehouse", "stock", "unit_cost", "avg_daily_demand", "annual_demand_qty"))


@query("demo_bom_position")
def demo_bom_position(spark, sf_dir):
    """With the demo recipes asked for and no recipes given, their components are stocked too."""
    t = tables(spark, sf_dir)
    m = SupplyModel(spark, {**tpch.role_tables(t), "bom": None}, PARAMS.with_(demo_bom=True), seed=True, sales_daily=tpch.sales_daily(t))
    return finalize(m.inventory.select("sku", "product", "warehouse", "stock", "unit_cost", "supplier_id"))


#: Headers as a shop might write them; every one is found by its role's names.
SHOP_HEADERS = {"sku": "Item SKU", "product": "Product Name", "stock": "Current Stock", "unit_cost": "Unit Cost (EUR)", "supplier_id": "Supplier ID",
                "warehouse": "Warehouse Location"}


def _shop_stock(spark, sf_dir) -> DataFrame:
    stock = tpch.inventory(tables(spark, sf_dir))
    return stock.select(*[F.col(c).alias(h) for c, h in SHOP_HEADERS.items()])


@query("compat_columns")
def compat_columns(spark, sf_dir):
    """The stock table under a shop's headers, found by substring matching."""
    from replenish.functions.naming import normalize_columns
    from replenish.operators.standardize import standardize
    shop = _shop_stock(spark, sf_dir)
    out = standardize("inventory", shop.toDF(*normalize_columns(shop.columns)), spark, match="compat")
    return finalize(out.select(*SHOP_HEADERS))


@query("role_override")
def role_override(spark, sf_dir):
    """Two stock tables in a workspace; the user's choice of role table holds, whatever is detected."""
    from replenish.sources.workspace import Workspace
    stock = tpch.inventory(tables(spark, sf_dir))
    ws = Workspace(spark).add("inventory", stock).add("Stock Count 2", stock.where(F.col("stock") > 0)).set_role("inventory", "stock_count_2")
    chosen = ws.role_tables()["inventory"]
    return finalize(chosen.groupBy("warehouse").agg(F.count(F.lit(1)).alias("rows"), F.sum("stock").alias("stock")))


# ---- streaming (E6) -------------------------------------------------------
@query("streaming_daily_demand")
def streaming_daily_demand(spark, sf_dir):
    from replenish.streaming.daily_demand import drain_daily_demand
    return finalize(drain_daily_demand(spark, sf_dir))


# ---- workspace metadata (N5-N8) ------------------------------------------
BENCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                "embeddings", "pages", "benchmark", "labels", "conversations")


@query("table_summary")
def table_summary(spark, sf_dir):
    from replenish.sources.workspace import Workspace
    ws = Workspace(spark)
    for name in BENCH_TABLES:
        ws.add(name, spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
    return ws.summary()


@query("demand_daily_series")
def demand_daily_series(spark, sf_dir):
    """Daily quantity per SKU over all history (products pooled)."""
    from replenish.operators.demand import daily_series
    return finalize(daily_series(model(spark, sf_dir).history))


PENALTY_MULT = 3.0


@query("cost_curves_penalty")
def cost_curves_penalty(spark, sf_dir):
    """O2: the cost curve under a stock-out penalty of 3 x unit cost."""
    return finalize(model(spark, sf_dir).cost_curves(PENALTY_MULT), 2)


@query("streaming_spike_watch")
def streaming_spike_watch(spark, sf_dir):
    """Days of the drained purchase stream above the SKU's D11 fence
    (SKUs with >= 10 days), emitted in append mode."""
    from replenish.streaming.daily_demand import drain_spike_watch
    return finalize(drain_spike_watch(spark, sf_dir))


# ---- listings and pick lists (B4, R17, R19, P7, F4, V4, K6) --------------
@query("bom_parents")
def bom_parents(spark, sf_dir):
    from replenish.operators.listings import parents
    return parents(model(spark, sf_dir).bom)


@query("risk_listing")
def risk_listing(spark, sf_dir):
    from replenish.operators.listings import risk_listing as rl
    return finalize(rl(model(spark, sf_dir).base))


@query("scenario_listing")
def scenario_listing(spark, sf_dir):
    from replenish.operators.listings import scenario_listing as sl
    return finalize(sl(model(spark, sf_dir).base))


@query("supplier_names")
def supplier_names(spark, sf_dir):
    from replenish.operators.listings import supplier_names as sn
    return sn(model(spark, sf_dir).supplier_risk())


@query("sku_list")
def sku_list(spark, sf_dir):
    from replenish.operators.listings import sku_list as sk
    return sk(model(spark, sf_dir).base)


@query("plan_suppliers")
def plan_suppliers(spark, sf_dir):
    from replenish.operators.listings import plan_suppliers as ps
    return ps(model(spark, sf_dir).base.where(F.col("recommended_order_qty") > 0))


@query("freight_listing")
def freight_listing(spark, sf_dir):
    from replenish.operators.listings import freight_listing as fl
    return finalize(fl(model(spark, sf_dir).freight()))


@query("finance_listing")
def finance_listing(spark, sf_dir):
    from replenish.operators.listings import finance_listing as fl
    return finalize(fl(model(spark, sf_dir).finance()))


@query("stock_preview")
def stock_preview(spark, sf_dir):
    """K6: the first 500 rows of a table in its order, as shown on screen."""
    from replenish.sinks.export import preview
    shown = finalize(model(spark, sf_dir).base.select("sku", "product", "warehouse", "stock", "days_of_cover", "next_eta"), 1)
    out = preview(shown, ["sku", "product", "warehouse"])
    return out.select("sku", "product", "warehouse", F.col("days_of_cover") == "\u221e", "next_eta").toDF(
        "sku", "product", "warehouse", "endless_cover", "next_eta")
