"""DuckDB oracle SQL for the query catalogue.

The SQL restates the same role mappings and formulas over the benchmark
tables, written with the same operation order so that doubles agree bit for
bit wherever the inputs are exact, and rounded (half-even) where sums of
doubles depend on summation order. It is an independent restatement used
only to check the Spark plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The planning settings that the catalogue runs with, written out."""

    horizon_days: int = 30
    window_days: int = 90
    service_level: float = 0.95
    order_cost: float = 35.0
    holding_cost_rate: float = 0.22
    demand_multiplier: float = 1.0
    lead_time_delay_days: float = 0.0


P0 = Settings()


def z_for_service(level: float) -> float:
    for least, z in ((0.99, 2.33), (0.98, 2.05), (0.95, 1.65), (0.90, 1.28), (0.85, 1.04)):
        if level >= least:
            return z
    return 0.84


def dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def r(expr: str, n: int = 4) -> str:
    """Half-even rounding; + 0.0 turns -0.0 into 0.0 as Spark prints it."""
    x = f"({expr})"
    return (f"(CASE WHEN isinf({x}) OR isnan({x}) THEN {x} "
            f"ELSE CAST(round_even(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE) END + 0.0)")


def dr(expr: str, n: int) -> str:
    """Half-even rounding on decimal digits (the engine's dround)."""
    return f"CAST(round_even(CAST(({expr}) AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def roles_sql() -> str:
    return f"""
sales AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date, CAST(l.l_partkey AS VARCHAR) AS sku, p.p_name AS product,
         greatest(l.l_quantity, {dbl(0)}) AS qty,
         l.l_extendedprice * ({dbl(1)} - l.l_discount) AS revenue,
         l.l_quantity * p.p_retailprice / 100 AS cost,
         l.l_extendedprice * ({dbl(1)} - l.l_discount) - l.l_quantity * p.p_retailprice / 100 AS profit
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
inventory AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS product,
         CAST((p_partkey * 37 + w * 53) % 160 AS DOUBLE) AS stock,
         p_retailprice / 100 AS unit_cost,
         CAST(p_partkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS supplier_id,
         'DC-' || CAST(w AS VARCHAR) AS warehouse,
         CAST(10 + (p_partkey % 5) * 10 AS DOUBLE) AS min_order_qty,
         CASE WHEN p_type = 'PROMO' THEN 'cold-chain' WHEN p_type = 'SMALL' THEN 'fragile' ELSE 'standard' END AS storage_class
  FROM part, (VALUES (1), (2), (3)) AS wt(w)
  WHERE (p_partkey % 4 = 0) OR (w = 1 + p_partkey % 3)),
suppliers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name,
         CAST(3 + s_suppkey % 26 AS DOUBLE) AS lead_time_days,
         CAST(1 + s_suppkey % 8 AS DOUBLE) AS lead_time_std_days,
         {dbl(0.6)} + CAST(s_suppkey % 40 AS DOUBLE) / {dbl(100)} AS on_time_rate,
         CAST(s_suppkey % 10 AS DOUBLE) / {dbl(50)} AS defect_rate,
         n_name AS country,
         'Net ' || CAST((1 + s_suppkey % 4) * 15 AS VARCHAR) AS payment_terms,
         CAST(300 + (s_suppkey % 18) * 100 AS DOUBLE) AS min_order_value
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
pos AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS po_id,
         CAST(l_partkey AS VARCHAR) AS sku, CAST(l_suppkey AS VARCHAR) AS supplier_id,
         l_quantity AS ordered_qty,
         CASE WHEN o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY THEN 'received'
              ELSE CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_transit' WHEN 'F' THEN 'received' END END AS status,
         CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS expected_date,
         l_extendedprice / l_quantity / 100 AS unit_cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
returns AS (
  SELECT CAST(l_shipdate AS DATE) + 7 AS date, CAST(l_partkey AS VARCHAR) AS sku,
         CAST(1 + l_linenumber % 3 AS DOUBLE) AS return_qty,
         CASE (l_partkey + l_orderkey) % 5 WHEN 0 THEN 'quality_issue' WHEN 1 THEN 'damaged'
              WHEN 2 THEN 'changed_mind' WHEN 3 THEN 'late_delivery' ELSE 'wrong_item' END AS reason,
         CAST(1 + l_linenumber % 3 AS DOUBLE) * (l_extendedprice * ({dbl(1)} - l_discount) / l_quantity) AS refund_amount
  FROM lineitem WHERE l_returnflag = 'R'),
bom AS (
  SELECT CAST(rr.pk AS VARCHAR) AS parent_sku, CAST(c.p_partkey AS VARCHAR) AS component_sku,
         c.p_name AS component_name, rr.qty_required
  FROM (SELECT p_partkey AS pk, p_partkey + 1 AS comp, CAST(1 + p_partkey % 3 AS DOUBLE) AS qty_required FROM part WHERE p_size > 45
        UNION ALL SELECT p_partkey, p_partkey + 2, {dbl(12)} FROM part WHERE p_size > 45
        UNION ALL SELECT p_partkey, p_partkey + 3, {dbl(2)} FROM part WHERE p_size <= 5) rr
  JOIN part c ON c.p_partkey = rr.comp)"""


def model_sql(p: Settings = P0, mult_in_stats: bool = True) -> str:
    n = float(p.window_days)
    mult = dbl(p.demand_multiplier) if mult_in_stats else dbl(1.0)
    z = z_for_service(p.service_level)
    oc = max(float(p.order_cost), 0.01)
    return roles_sql() + f""",
anchor AS (SELECT max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem),
daily AS (
  SELECT sku, product, date, coalesce(sum(qty), 0) AS qty, coalesce(sum(revenue), 0) AS revenue,
         coalesce(sum(profit), 0) AS profit
  FROM sales, anchor WHERE date >= hi - {p.window_days - 1} AND date <= hi GROUP BY sku, product, date),
agg AS (
  SELECT sku, product, sum(qty) AS s1, sum(qty * qty) AS s2, sum(revenue) AS rev, sum(profit) AS prof,
         coalesce(sum(CASE WHEN date >= hi - 29 THEN qty END), 0) AS recent_30d_qty
  FROM daily, anchor GROUP BY sku, product),
stats AS (
  SELECT sku, product,
         s1 / {dbl(n)} * {mult} AS avg_daily_demand,
         sqrt(greatest((s2 - s1 * s1 / {dbl(n)}) / {dbl(n - 1)}, {dbl(0)})) * {mult} AS std_daily_demand,
         recent_30d_qty,
         s1 / {dbl(n)} * {dbl(365)} AS annual_demand_qty,
         rev / {dbl(n)} * {dbl(365)} AS annual_revenue,
         prof / {dbl(n)} * {dbl(365)} AS annual_profit,
         s1 / {dbl(n)} * {mult} * {dbl(p.horizon_days)} AS forecast_horizon_qty
  FROM agg),
sd AS (
  SELECT coalesce(i.sku, s.sku) AS sku, coalesce(i.product, s.product) AS product,
         coalesce(i.stock, 0.0) AS stock, coalesce(i.unit_cost, 0.0) AS unit_cost,
         coalesce(i.supplier_id, 'UNKNOWN') AS supplier_id, coalesce(i.warehouse, 'Unassigned') AS warehouse,
         coalesce(i.min_order_qty, 1.0) AS min_order_qty, coalesce(i.storage_class, 'standard') AS storage_class,
         coalesce(s.avg_daily_demand, 0.0) AS avg_daily_demand, coalesce(s.std_daily_demand, 0.0) AS std_daily_demand,
         s.recent_30d_qty,
         coalesce(s.annual_demand_qty, 0.0) AS annual_demand_qty, coalesce(s.annual_revenue, 0.0) AS annual_revenue,
         coalesce(s.annual_profit, 0.0) AS annual_profit, coalesce(s.forecast_horizon_qty, 0.0) AS forecast_horizon_qty
  FROM inventory i FULL OUTER JOIN stats s ON i.sku = s.sku AND i.product = s.product),
parent AS (
  SELECT sku AS parent_sku, sum(avg_daily_demand) AS p_avg, sum(std_daily_demand) AS p_std,
         sum(forecast_horizon_qty) AS p_fc, sum(annual_demand_qty) AS p_ann
  FROM sd GROUP BY sku),
dep AS (
  SELECT component_sku AS sku, sum(coalesce(p_avg, 0.0) * qty_required) AS dep_avg,
         sum(coalesce(p_std, 0.0) * qty_required) AS dep_std, sum(coalesce(p_fc, 0.0) * qty_required) AS dep_fc,
         sum(coalesce(p_ann, 0.0) * qty_required) AS dep_ann
  FROM bom LEFT JOIN parent USING (parent_sku)
  WHERE bom.parent_sku IS NOT NULL AND bom.component_sku IS NOT NULL GROUP BY component_sku),
pb AS (
  SELECT x.sku, x.product, x.stock, x.unit_cost, x.supplier_id, x.warehouse, x.min_order_qty, x.storage_class,
         x.recent_30d_qty, x.annual_revenue, x.annual_profit,
         CASE WHEN d.sku IS NOT NULL THEN d.dep_avg ELSE x.avg_daily_demand END AS avg_daily_demand,
         CASE WHEN d.sku IS NOT NULL THEN d.dep_std ELSE x.std_daily_demand END AS std_daily_demand,
         CASE WHEN d.sku IS NOT NULL THEN d.dep_fc ELSE x.forecast_horizon_qty END AS forecast_horizon_qty,
         CASE WHEN d.sku IS NOT NULL THEN d.dep_ann ELSE x.annual_demand_qty END AS annual_demand_qty,
         d.sku IS NOT NULL AS is_component,
         coalesce(d.dep_avg, 0.0) AS component_avg_daily_demand, coalesce(d.dep_std, 0.0) AS component_std_daily_demand,
         coalesce(d.dep_fc, 0.0) AS component_forecast_qty, coalesce(d.dep_ann, 0.0) AS component_annual_demand
  FROM sd x LEFT JOIN dep d ON x.sku = d.sku),
ps AS (
  SELECT pb.*, s.supplier_name,
         coalesce(s.lead_time_days, 10.0) + {dbl(p.lead_time_delay_days)} AS lead_time_days,
         coalesce(s.lead_time_std_days, 3.0) AS lead_time_std_days,
         coalesce(s.on_time_rate, 0.85) AS on_time_rate, coalesce(s.defect_rate, 0.02) AS defect_rate,
         s.country, s.payment_terms, s.min_order_value
  FROM pb LEFT JOIN suppliers s USING (supplier_id)),
incoming AS (
  SELECT sku, sum(ordered_qty) AS incoming_qty, min(expected_date) AS next_eta FROM pos
  WHERE status NOT IN ('closed', 'cancelled', 'received', 'complete', 'completed') GROUP BY sku),
position AS (
  SELECT ps.*, coalesce(i.incoming_qty, 0.0) AS incoming_qty, i.next_eta
  FROM ps LEFT JOIN incoming i USING (sku)),
m1 AS (
  SELECT *,
         CASE WHEN storage_class = 'fragile' THEN {dbl(0.28)} WHEN storage_class = 'cold-chain' THEN {dbl(0.35)}
              ELSE {dbl(p.holding_cost_rate)} END AS holding_cost_rate,
         {dbl(z)} * std_daily_demand * sqrt(greatest(lead_time_days, {dbl(1)})) AS safety_stock,
         CASE WHEN avg_daily_demand > 0 THEN stock / avg_daily_demand ELSE CAST('inf' AS DOUBLE) END AS days_of_cover,
         stock + incoming_qty AS net_position
  FROM position),
m2 AS (
  SELECT *, avg_daily_demand * lead_time_days + safety_stock AS reorder_point,
         sqrt({dbl(2)} * greatest(annual_demand_qty, {dbl(0)}) * {dbl(oc)}
              / greatest(holding_cost_rate * (CASE WHEN unit_cost = 0 THEN {dbl(1)} ELSE unit_cost END), {dbl(0.01)})) AS eoq
  FROM m1),
m3 AS (
  SELECT *, greatest(reorder_point - net_position, {dbl(0)}) AS shortage_qty FROM m2),
m4 AS (
  SELECT *,
         {dr("greatest(" + dr(f"greatest(shortage_qty, CASE WHEN shortage_qty > 0 THEN eoq ELSE {dbl(0)} END)", 0) + f", CASE WHEN shortage_qty > 0 THEN min_order_qty ELSE {dbl(0)} END)", 0)} AS recommended_order_qty,
         stock * unit_cost AS inventory_value,
         CASE WHEN avg_daily_demand <= 0 AND stock > 0 THEN 'Dead-stock risk'
              WHEN days_of_cover <= greatest({dbl(3)}, lead_time_days * {dbl(0.35)}) THEN 'Critical'
              WHEN net_position < reorder_point THEN 'High'
              WHEN days_of_cover <= lead_time_days + 7 THEN 'Medium'
              ELSE 'Low' END AS stockout_risk,
         (avg_daily_demand < 0.2 AND stock > 0) AS dead_stock_flag,
         (days_of_cover > 90 AND stock > 0) AS overstock_flag
  FROM m3),
base AS (SELECT *, recommended_order_qty * unit_cost AS recommended_order_value FROM m4),
health AS (
  SELECT *,
         CASE WHEN (SELECT sum(annual_revenue) FROM base) > 0
              THEN sum(annual_revenue) OVER (ORDER BY annual_revenue DESC, sku, product, warehouse
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                   / (SELECT sum(annual_revenue) FROM base)
              ELSE {dbl(0)} END AS cum_revenue_pct
  FROM base),
health_abc AS (
  SELECT *, CASE WHEN (SELECT sum(annual_revenue) FROM base) <= 0 THEN 'C'
                 WHEN cum_revenue_pct <= 0.80 THEN 'A' WHEN cum_revenue_pct <= 0.95 THEN 'B' ELSE 'C' END AS abc_class
  FROM health)"""


def with_model(select: str, p: Settings = P0) -> str:
    return "WITH " + model_sql(p) + "\n" + select


def with_roles(select: str) -> str:
    return "WITH " + roles_sql() + "\n" + select
