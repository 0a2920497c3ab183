"""The planning model: one lazy DataFrame per result.

Nothing runs when the model is built except the small probes that decide the
data-dependent branches of the original (empty inventory / suppliers / BOM)
and the one-value job that fetches the latest sale date (skipped when the
caller passes ``anchor``)."""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish import schemas
from replenish.operators import demand as D
from replenish.operators import economics as E
from replenish.operators import position as J
from replenish.operators import reorder as R
from replenish.operators import returns as T
from replenish.operators import suppliers as SP
from replenish.operators.standardize import empty, standardize
from replenish.params import PlanParams
from replenish.session import scratch_path

STATS_SCHEMA = ("sku string, product string, avg_daily_demand double, std_daily_demand double, "
                "recent_30d_qty double, annual_demand_qty double, annual_revenue double, annual_profit double, "
                "forecast_horizon_qty double")


class SupplyModel:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | None],
                 params: PlanParams | None = None, standardized: bool = False,
                 anchor: _dt.date | None = None, seed: bool = True, sales_daily: DataFrame | None = None):
        self.spark = spark
        self.params = params or PlanParams()
        p = self.params
        std = {}
        for role in schemas.ROLES:
            df = tables.get(role)
            if standardized and df is not None:
                std[role] = df
            elif role == "purchase_orders":
                std[role] = standardize(role, df, spark, match=p.match, as_of=p.as_of)
            else:
                std[role] = standardize(role, df, spark, match=p.match)
        self.sales = std["sales"]
        inv, sup, bom = std["inventory"], std["suppliers"], std["bom"]
        if seed:
            bom_empty = p.demo_bom and bom.isEmpty()
            if bom_empty:
                bom = J.demo_bom(spark)
            if inv.isEmpty() and not self.sales.isEmpty():
                inv = D.seed_inventory(self.sales)
            if bom_empty and not inv.isEmpty():
                inv = J.add_demo_components(inv)
            if sup.isEmpty() and not inv.isEmpty():
                sup = J.seed_suppliers(inv)
        self.inventory, self.suppliers, self.bom = inv, sup, bom
        self.purchase_orders, self.returns = std["purchase_orders"], std["returns"]
        self._anchor = anchor
        # optional daily sales source: (sku, product, date, qty, revenue,
        # profit), unique per (sku, product, date), aggregated before any
        # dimension join; used for every day-level demand computation
        self._sales_daily = sales_daily
        self._materialized: str | None = None
        self._stock_demand: DataFrame | None = None
        self._position_cols: list[str] = []

    # ---- demand -------------------------------------------------------
    @cached_property
    def window(self):
        return D.window_bounds(self.sales, self.params, self._anchor)

    @cached_property
    def daily(self) -> DataFrame:
        lo, hi = self.window
        if hi is None:
            return self.spark.createDataFrame([], "sku string, product string, date date, qty double, revenue double, profit double")
        if self._sales_daily is not None:
            return self._sales_daily.where((F.col("date") >= F.lit(lo)) & (F.col("date") <= F.lit(hi))).select(
                "sku", "product", "date", "qty", "revenue", "profit")
        return D.daily_demand(self.sales, lo, hi)

    def stats(self, scaled: bool = True) -> DataFrame:
        lo, hi = self.window
        if hi is None:
            return self.spark.createDataFrame([], STATS_SCHEMA)
        return D.demand_stats(self.daily, hi, self.params, scaled=scaled)

    @cached_property
    def history(self) -> DataFrame:
        """All-history (sku, product, date) sums; written once when the model
        is materialised (the spike watch, daily series, projection and return
        rates read it instead of re-joining the whole sales history)."""
        h = (self._sales_daily.select("sku", "product", "date", "qty") if self._sales_daily is not None
             else D.daily_history(self.sales))
        if self._materialized is None:
            return h
        path = scratch_path(self.spark, "history")
        h.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def dense_calendar(self) -> DataFrame:
        lo, hi = self.window
        return D.dense_calendar(self.daily, lo, hi)

    # ---- position -----------------------------------------------------
    def position(self, scaled: bool = True) -> DataFrame:
        """J1-J4 + B1-B3: stock x demand, BOM override, suppliers, incoming."""
        if self._materialized is not None and (scaled or self.params.demand_multiplier == 1.0):
            # reorder maths only adds columns: the position is a projection
            return self.base.select(*self._position_cols)
        base = self._stock_demand if scaled and self._stock_demand is not None else \
            J.stock_demand(self.inventory, self.stats(scaled))
        base = J.apply_bom(base, self.bom, self.params.bom_levels)
        # incoming joins on sku right after the BOM join (same partitioning,
        # no re-shuffle); the supplier join comes last
        base = J.with_incoming(base, self.purchase_orders)
        return J.with_suppliers(base, self.suppliers, self.params.lead_time_delay_days)

    @cached_property
    def base(self) -> DataFrame:
        """Planning rows with reorder maths, risk and flags (no ABC)."""
        return R.reorder_columns(self.position(), self.params)

    @cached_property
    def health(self) -> DataFrame:
        """Planning rows with ABC classes."""
        return R.abc_classes(self.base)

    def materialize(self) -> "SupplyModel":
        """Cut the lineage of the planning rows: write them once into the
        shared checkpoint folder so that every consumer (ABC scan, supplier
        roll-up, transfers, alerts, ...) reads one copy, and a lost executor
        re-reads files instead of recomputing the demand pipeline."""
        if self._materialized is None:
            # stage 1: the sales aggregation joined to stock, written once;
            # the BOM parent demand and the main branch both read this copy
            sd_path = scratch_path(self.spark, "stock-demand")
            J.stock_demand(self.inventory, self.stats()).write.mode("overwrite").parquet(sd_path)
            self._stock_demand = self.spark.read.parquet(sd_path)
            self.__dict__.pop("base", None)
            self._position_cols = self.position().columns
            # stage 2: BOM, suppliers, incoming and reorder maths, as plain
            # Parquet: buckets by sku would put a hot SKU into one task of
            # every consumer
            path = scratch_path(self.spark, "base")
            self.base.write.mode("overwrite").parquet(path)
            self._materialized = path
            self.__dict__["base"] = self.spark.read.parquet(path)
            self.__dict__.pop("health", None)
        return self

    def persist(self) -> "SupplyModel":
        self.__dict__["health"] = self.health.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    # ---- consumers ----------------------------------------------------
    def first_rows(self) -> DataFrame:
        """One planning row per sku in inventory-health order."""
        order = [F.col("stockout_risk"), -F.col("inventory_value"), F.col("warehouse"), F.col("product")]
        cols = [c for c in self.base.columns if c != "sku"]
        return J.first_per_key(self.base, ["sku"], order, cols)

    def reorder_plan(self) -> DataFrame:
        """R14; narrow rows are ranked unless the classes of all planning rows are there already."""
        return R.reorder_plan(self.health) if "health" in self.__dict__ else R.classed_plan(self.base)

    @cached_property
    def _supplier_risk(self) -> DataFrame:
        return SP.supplier_risk(self.base, self.suppliers)

    def supplier_risk(self) -> DataFrame:
        return self._supplier_risk

    @cached_property
    def transfers(self) -> DataFrame:
        """X1-X5, the original greedy; written once when the model is
        materialised (KPIs, alerts and the report all read it)."""
        from replenish.operators.transfers import exact_transfers
        t = exact_transfers(self.base)
        if self._materialized is None:
            return t
        path = scratch_path(self.spark, "transfers")
        t.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def whole_transfers(self) -> DataFrame:
        """X1-X5 on whole units (built once: its scans checkpoint eagerly)."""
        from replenish.operators.transfers import whole_unit_transfers
        return whole_unit_transfers(self.base)

    def freight(self) -> DataFrame:
        return E.freight_modes(self.base, self.params.service_level)

    def finance(self) -> DataFrame:
        return E.financial_velocity(self.base)

    def cost_curves(self, penalty_mult: float = 1.5) -> DataFrame:
        return E.cost_curves(self.base, self.params.holding_cost_rate, penalty_mult)

    def sku_returns(self) -> DataFrame:
        return T.sku_return_rate(self.base, self.returns, self.history)

    def supplier_returns(self) -> DataFrame:
        return T.supplier_returns(self.base, self.returns)

    # ---- exports (K2-K5) ------------------------------------------------
    def result_tables(self) -> dict[str, DataFrame]:
        """The model's tables under the original result names."""
        from replenish.operators.demand import demand_spikes
        from replenish.operators.economics import cost_curves
        from replenish.operators.outputs import alerts, kpis, playbooks, report_lines
        from replenish.operators.returns import by_reason
        t = {
            "inventory_health": self.health,
            "reorder_plan": self.reorder_plan(),
            "supplier_risk": self.supplier_risk(),
            "anomalies": demand_spikes(self.sales, daily=self.history),
            "sku_returns": self.sku_returns(),
            "supplier_returns": self.supplier_returns(),
            "transfers": self.transfers,
            "bom": self.bom,
            "freight_comparisons": self.freight(),
            "financial_kpis": self.finance(),
            "alerts": alerts(self.base, self.supplier_risk(), self.transfers, self.params.alert_caps),
            "automation_playbooks": playbooks(self.spark),
            "returns_by_reason": by_reason(self.returns),
            "cost_curves": cost_curves(self.base, self.params.holding_cost_rate),
        }
        t["kpis"] = kpis(self.base, t["supplier_risk"], self.returns, t["transfers"], t["financial_kpis"],
                         self.params.horizon_days, self.params.service_level)
        t["report"] = report_lines(t["kpis"], self.base.where(F.col("recommended_order_qty") > 0), t["supplier_risk"], t["alerts"])
        p = self.params
        t["params"] = self.spark.createDataFrame(
            [(p.horizon_days, p.service_level, p.order_cost, p.holding_cost_rate, p.demand_multiplier,
              p.lead_time_delay_days)],
            "horizon_days int, service_level double, order_cost double, holding_cost_rate double, "
            "demand_multiplier double, lead_time_delay_days double")
        return t

    @staticmethod
    def table_orders() -> dict[str, list]:
        """The order of the tables that have one (a capped audit keeps their first rows)."""
        from replenish.operators.reorder import plan_order, revenue_order
        c = F.col
        return {
            "inventory_health": revenue_order(), "reorder_plan": plan_order(),
            "supplier_risk": [c("supplier_risk_score").desc(), c("supplier_id")],
            "transfers": [c("saved_value").desc(), c("sku"), c("from_warehouse"), c("to_warehouse")],
            "freight_comparisons": [c("cost_difference").desc(), c("sku")],
            "financial_kpis": [c("annual_carrying_cost").desc(), c("sku")],
            "alerts": [c("alert_group"), c("rank")], "report": [c("section"), c("item")],
            "cost_curves": [c("service_level")], "sku_returns": [c("return_rate").desc(), c("sku")],
        }

    def export_audit(self, path: str, cap: int | None = None) -> None:
        """K2: every result table as JSON lines (whole tables unless ``cap``)."""
        from replenish.sinks.export import write_audit
        write_audit(self.result_tables(), path, cap=cap, orders=self.table_orders())

    def export_bundle(self, path: str, fmt: str = "parquet") -> None:
        """K3: the workbook's tables as one folder per sheet name."""
        from replenish.sinks.export import write_bundle
        write_bundle(self.result_tables(), path, fmt)

    def automation(self, path: str, webhook_url: str = "") -> DataFrame:
        """K4: writes the transfer list under ``path`` and returns the
        one-row payload frame that points to it."""
        from replenish.sinks.export import automation_payload, write_audit
        t = self.result_tables()
        write_audit({"transfers": t["transfers"]}, path)
        return automation_payload(t["automation_playbooks"], t["alerts"], f"{path.rstrip('/')}/transfers",
                                  webhook_url=webhook_url)

