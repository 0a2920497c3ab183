"""Oracle SQL text per catalogue query (see ``replenish.plans.oracle``)."""

from __future__ import annotations

from replenish.operators.outputs import PLAYBOOKS
from replenish.operators.position import DEMO_BOM, DEMO_COMPONENT_STOCK
from replenish.plans.oracle import dbl, dr, model_sql, r, roles_sql, with_model, with_roles


def with_model_ctes(ctes: str, select: str) -> str:
    return "WITH " + model_sql() + ",\n" + ctes + "\n" + select


def with_roles_ctes(ctes: str, select: str) -> str:
    return "WITH " + roles_sql() + ",\n" + ctes + "\n" + select

ORACLES: dict[str, str] = {}
AM = {"annual_revenue": 6, "annual_profit": 6}


def cols(names, rounding: dict[str, int] | None = None, default: int | None = None, doubles=()) -> str:
    rounding = rounding or {}
    out = []
    for n in names:
        if n in rounding:
            out.append(f"{r(n, rounding[n])} AS {n}")
        elif default is not None and n in doubles:
            out.append(f"{r(n, default)} AS {n}")
        else:
            out.append(n)
    return ", ".join(out)


ORACLES["std_sales"] = f"""
SELECT r_name AS region, o_orderpriority AS channel, c_mktsegment AS segment, count(*) AS rows,
       {r('sum(l_quantity)')} AS qty,
       {r('sum(l_extendedprice * (CAST(1.0 AS DOUBLE) - l_discount))')} AS revenue,
       {r('sum(l_quantity * p_retailprice / 100)')} AS cost,
       {r('sum(l_extendedprice * (CAST(1.0 AS DOUBLE) - l_discount) - l_quantity * p_retailprice / 100)')} AS profit
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, o_orderpriority, c_mktsegment"""

ORACLES["std_inventory"] = with_roles(f"""
SELECT sku, product, {r('stock')} AS stock, {r('unit_cost')} AS unit_cost, supplier_id, warehouse,
       {r('min_order_qty')} AS min_order_qty, storage_class FROM inventory""")

ORACLES["std_suppliers"] = with_roles(f"""
SELECT supplier_id, supplier_name, {r('lead_time_days')} AS lead_time_days, {r('lead_time_std_days')} AS lead_time_std_days,
       {r('on_time_rate')} AS on_time_rate, {r('defect_rate')} AS defect_rate, country, payment_terms,
       {r('min_order_value')} AS min_order_value FROM suppliers""")

ORACLES["std_pos"] = with_roles(f"""
SELECT po_id, sku, supplier_id, {r('ordered_qty')} AS ordered_qty, status, order_date, expected_date,
       {r('unit_cost')} AS unit_cost FROM pos""")

ORACLES["std_returns"] = with_roles(f"""
SELECT date, sku, {r('return_qty')} AS return_qty, reason, {r('refund_amount')} AS refund_amount FROM returns""")

ORACLES["std_bom"] = with_roles(f"""
SELECT parent_sku, component_sku, component_name, {r('qty_required')} AS qty_required FROM bom""")

ORACLES["demand_daily"] = with_model(f"""
SELECT sku, product, date, {r('qty')} AS qty, {r('revenue')} AS revenue, {r('profit')} AS profit FROM daily""")

ORACLES["demand_dense_calendar"] = with_model(f"""
SELECT k.sku, k.product, c.date, {r('coalesce(d.qty, 0.0)')} AS qty, {r('coalesce(d.revenue, 0.0)')} AS revenue,
       {r('coalesce(d.profit, 0.0)')} AS profit
FROM (SELECT DISTINCT sku, product FROM daily) k
CROSS JOIN (SELECT CAST(unnest(generate_series(hi - 89, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM anchor) c
LEFT JOIN daily d ON d.sku = k.sku AND d.product = k.product AND d.date = c.date""")

_STATS = ["sku", "product", "avg_daily_demand", "std_daily_demand", "recent_30d_qty", "annual_demand_qty",
          "annual_revenue", "annual_profit", "forecast_horizon_qty"]
ORACLES["demand_stats"] = with_model(f"""
SELECT {cols(_STATS, AM, 4, _STATS[2:])} FROM stats""")

_BP = ["sku", "product", "warehouse", "stock", "unit_cost", "supplier_id", "supplier_name", "min_order_qty",
       "storage_class", "avg_daily_demand", "std_daily_demand", "recent_30d_qty", "annual_demand_qty",
       "annual_revenue", "annual_profit", "forecast_horizon_qty", "is_component", "lead_time_days",
       "lead_time_std_days", "on_time_rate", "defect_rate", "incoming_qty", "next_eta"]
_BP_D = ["stock", "unit_cost", "min_order_qty", "avg_daily_demand", "std_daily_demand", "recent_30d_qty",
         "annual_demand_qty", "annual_revenue", "annual_profit", "forecast_horizon_qty", "lead_time_days",
         "lead_time_std_days", "on_time_rate", "defect_rate", "incoming_qty"]
ORACLES["base_position"] = with_model(f"""
SELECT {cols(_BP, AM, 4, _BP_D)} FROM position""")

_RM = ["sku", "product", "warehouse", "holding_cost_rate", "safety_stock", "reorder_point", "days_of_cover",
       "net_position", "shortage_qty", "eoq", "recommended_order_qty", "inventory_value", "recommended_order_value",
       "stockout_risk", "dead_stock_flag", "overstock_flag"]
_RM_D = ["holding_cost_rate", "safety_stock", "reorder_point", "days_of_cover", "net_position", "shortage_qty",
         "eoq", "recommended_order_qty", "inventory_value", "recommended_order_value"]
ORACLES["reorder_math"] = with_model(f"SELECT {cols(_RM, None, 4, _RM_D)} FROM base")

_RP = ["sku", "product", "supplier_id", "supplier_name", "stock", "incoming_qty", "avg_daily_demand",
       "days_of_cover", "lead_time_days", "safety_stock", "reorder_point", "recommended_order_qty",
       "recommended_order_value", "stockout_risk", "abc_class", "warehouse"]
_RP_D = ["stock", "incoming_qty", "avg_daily_demand", "days_of_cover", "lead_time_days", "safety_stock",
         "reorder_point", "recommended_order_qty", "recommended_order_value"]
ORACLES["reorder_plan"] = with_model(f"""
SELECT {cols(_RP, None, 4, _RP_D)} FROM health_abc WHERE recommended_order_qty > 0""")

_IH = ["sku", "product", "warehouse", "stock", "avg_daily_demand", "days_of_cover", "inventory_value",
       "stockout_risk", "dead_stock_flag", "overstock_flag", "cum_revenue_pct", "abc_class"]
ORACLES["inventory_health"] = with_model(f"""
SELECT {cols(_IH, {'cum_revenue_pct': 6}, 4, ['stock', 'avg_daily_demand', 'days_of_cover', 'inventory_value'])}
FROM health_abc""")


# first planning row per sku in inventory-health order
FIRST_ROWS = """fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY stockout_risk,
    inventory_value DESC, warehouse, product) AS rn FROM base) WHERE rn = 1)"""
# first planning row per sku in revenue order
SKU_FIRST = """sf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY annual_revenue DESC,
    product, warehouse) AS rn FROM position) WHERE rn = 1)"""

ORACLES["demand_forecast_top20"] = with_model(f"""
SELECT sku, product, warehouse, {r('forecast_horizon_qty')} AS forecast_horizon_qty,
       {r('avg_daily_demand')} AS avg_daily_demand, stockout_risk
FROM base ORDER BY forecast_horizon_qty DESC, sku, product, warehouse LIMIT 20""")

ORACLES["forecast_projection"] = with_model_ctes(f"""{FIRST_ROWS},
lastd AS (SELECT sku, max(date) AS last_date FROM sales GROUP BY sku),
proj AS (SELECT l.sku, CAST(unnest(generate_series(l.last_date + 1, l.last_date + 30, INTERVAL 1 DAY)) AS DATE) AS date,
                fr.avg_daily_demand, fr.reorder_point, fr.safety_stock
         FROM lastd l JOIN fr ON l.sku = fr.sku)
SELECT sku, date, {r('avg_daily_demand')} AS forecast_qty, {r('reorder_point')} AS reorder_point,
       {r('safety_stock')} AS safety_stock FROM proj""", "")


ORACLES["demand_spikes"] = with_roles_ctes(f"""dsku AS (SELECT sku, product, date, sum(qty) AS qty FROM sales GROUP BY sku, product, date),
st AS (SELECT sku, quantile_cont(qty, 0.75) + (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) * {dbl(1.5)} AS upper,
              avg(qty) + stddev_samp(qty) * 2 AS two_sigma
       FROM dsku GROUP BY sku HAVING count(*) >= 10),
hits AS (SELECT d.*, upper, row_number() OVER (PARTITION BY d.sku ORDER BY product DESC, date DESC) AS rn
         FROM dsku d JOIN st ON d.sku = st.sku WHERE d.qty > greatest(upper, two_sigma))
SELECT sku, product, strftime(date, '%Y-%m-%d') AS date, 'demand_spike' AS metric, {r('qty')} AS value,
       {r('greatest(upper, 0.0)')} AS expected_upper,
       CASE WHEN qty < upper * {dbl(1.8)} THEN 'Medium' ELSE 'High' END AS severity
FROM hits WHERE rn <= 5""", "")


ORACLES["seed_inventory_from_sales"] = with_roles_ctes("""
cnt AS (SELECT sku, product, date, qty, count(*) AS c FROM sales GROUP BY sku, product, date, qty),
cum AS (SELECT *, sum(c) OVER (PARTITION BY sku, product ORDER BY date DESC, qty DESC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc FROM cnt),
tk AS (SELECT sku, product, qty, least(c, greatest(0, 30 - (cc - c))) AS t FROM cum),
tl AS (SELECT sku, product, sum(t * qty) / sum(t) AS tail_mean FROM tk GROUP BY sku, product),
cst AS (SELECT sku, product, avg(cost) AS unit_cost FROM sales GROUP BY sku, product)""", f"""
SELECT tl.sku, tl.product, {r('CAST(greatest(0, floor(tail_mean * 15)) AS DOUBLE)')} AS stock, {r('unit_cost')} AS unit_cost,
       'UNKNOWN' AS supplier_id, 'Unassigned' AS warehouse, {r('1.0')} AS min_order_qty, 'standard' AS storage_class
FROM tl JOIN cst ON tl.sku = cst.sku AND tl.product = cst.product""")

ORACLES["seed_suppliers"] = with_roles(f"""
SELECT supplier_id, supplier_id AS supplier_name, {r('10.0')} AS lead_time_days, {r('3.0')} AS lead_time_std_days,
       {r('0.85')} AS on_time_rate, {r('0.02')} AS defect_rate, 'Unknown' AS country, 'Unknown' AS payment_terms,
       {r('0.0')} AS min_order_value
FROM (SELECT DISTINCT coalesce(supplier_id, 'UNKNOWN') AS supplier_id FROM inventory)""")

ORACLES["bom_dependent_demand"] = with_model(f"""
SELECT sku AS component_sku, {r('dep_avg')} AS dep_avg_daily_demand, {r('dep_std')} AS dep_std_daily_demand,
       {r('dep_fc')} AS dep_forecast_horizon_qty, {r('dep_ann')} AS dep_annual_demand_qty FROM dep""")

ORACLES["bom_multilevel_demand"] = "WITH RECURSIVE " + model_sql() + f""",
recipe AS (SELECT parent_sku, component_sku, qty_required FROM bom WHERE parent_sku IS NOT NULL AND component_sku IS NOT NULL),
path AS (
  SELECT component_sku AS sku, 1 AS level, coalesce(p_avg, 0.0) * qty_required AS a, coalesce(p_std, 0.0) * qty_required AS s,
         coalesce(p_fc, 0.0) * qty_required AS f, coalesce(p_ann, 0.0) * qty_required AS y
  FROM recipe LEFT JOIN parent USING (parent_sku) WHERE parent_sku NOT IN (SELECT component_sku FROM recipe)
  UNION ALL
  SELECT component_sku, level + 1, a * qty_required, s * qty_required, f * qty_required, y * qty_required
  FROM path JOIN recipe ON parent_sku = sku)
SELECT sku, CAST(max(level) AS INT) AS low_level_code, {r('sum(a)')} AS dep_avg_daily_demand, {r('sum(s)')} AS dep_std_daily_demand,
       {r('sum(f)')} AS dep_forecast_horizon_qty, {r('sum(y)')} AS dep_annual_demand_qty
FROM path GROUP BY sku"""

ORACLES["bom_explosion"] = with_model_ctes(FIRST_ROWS, f"""
SELECT b.parent_sku, b.component_sku, b.component_name, {r('b.qty_required')} AS qty_required,
       c.warehouse AS component_warehouse, {r('coalesce(c.stock, 0.0)')} AS stock,
       {r(dr('b.qty_required * fr.forecast_horizon_qty', 1))} AS required_for_forecast,
       {r(dr('greatest(' + dr('b.qty_required * fr.forecast_horizon_qty', 1) + ' - coalesce(c.stock, 0.0), 0.0)', 1))} AS shortage_for_forecast
FROM bom b JOIN fr ON fr.sku = b.parent_sku LEFT JOIN base c ON c.sku = b.component_sku""")

ORACLES["bom_component_plan"] = with_model(f"""
SELECT sku, product, warehouse, {r('stock')} AS stock, {r('avg_daily_demand')} AS avg_daily_demand,
       {r('reorder_point')} AS reorder_point, {r('recommended_order_qty')} AS recommended_order_qty,
       {r('recommended_order_value')} AS recommended_order_value, stockout_risk
FROM base WHERE sku IN (SELECT component_sku FROM bom)""")

_CB = ["sku", "product", "warehouse", "avg_daily_demand", "lead_time_days", "lead_time_demand", "z",
       "std_daily_demand", "safety_stock", "reorder_point", "stock", "incoming_qty", "net_position", "shortage_qty",
       "annual_demand_qty", "order_cost", "holding_cost_rate", "unit_cost", "eoq", "min_order_qty",
       "recommended_order_qty"]
ORACLES["calc_breakdown"] = with_model(f"""
SELECT {cols(_CB, None, 4, _CB[3:])} FROM (
  SELECT *, avg_daily_demand * lead_time_days AS lead_time_demand, {dbl(1.65)} AS z, {dbl(35.0)} AS order_cost FROM base)""")

ORACLES["risk_distribution"] = with_model("SELECT stockout_risk AS risk, count(*) AS count FROM base GROUP BY stockout_risk")

ORACLES["dead_overstock"] = with_model(f"""
SELECT sku, product, warehouse, {r('stock')} AS stock, {r('days_of_cover')} AS days_of_cover, dead_stock_flag, overstock_flag
FROM base WHERE dead_stock_flag OR overstock_flag""")

ORACLES["abc_classes"] = with_model(f"""
SELECT abc_class, count(*) AS rows, {r('sum(annual_revenue)', 1)} AS annual_revenue,
       {r('max(cum_revenue_pct)', 6)} AS max_cum_revenue_pct FROM health_abc GROUP BY abc_class""")

ORACLES["inventory_map"] = with_model(f"""
SELECT sku, product, warehouse, {r("CASE WHEN isinf(days_of_cover) OR isnan(days_of_cover) THEN NULL ELSE days_of_cover END")} AS days_of_cover,
       {r('inventory_value')} AS inventory_value, {r('stock')} AS stock, stockout_risk FROM base""")

SUPPLIER_RISK = f"""sr0 AS (
  SELECT supplier_id, sum(inventory_value) AS supplier_inventory_value, count(DISTINCT sku) AS supplier_skus,
         avg(lead_time_days) AS avg_lead_time, avg(lead_time_std_days) AS avg_lead_time_std,
         avg(on_time_rate) AS avg_on_time_rate, avg(defect_rate) AS avg_defect_rate,
         CAST(sum(CASE WHEN stockout_risk = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_skus,
         CAST(sum(CASE WHEN stockout_risk IN ('Critical', 'High') THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_skus,
         sum(recommended_order_value) AS recommended_order_value, avg(unit_cost) AS avg_unit_cost
  FROM base GROUP BY supplier_id),
sr1 AS (
  SELECT *, {dr(f'''least(greatest(({dbl(1)} - least(greatest(avg_on_time_rate, {dbl(0)}), {dbl(1)})) * 45
        + least(greatest(avg_defect_rate, {dbl(0)}), {dbl(1)}) * 250
        + least(greatest(avg_lead_time, {dbl(0)}), {dbl(60)}) / 60 * 25
        + least(greatest(avg_lead_time_std, {dbl(0)}), {dbl(20)}) / 20 * 15
        + least(high_risk_skus, 5) * 3, {dbl(0)}), {dbl(100)})''', 1)} AS supplier_risk_score FROM sr0),
sdet AS (SELECT * FROM (SELECT supplier_id, supplier_name, country, payment_terms, min_order_value,
         row_number() OVER (PARTITION BY supplier_id ORDER BY supplier_name) AS rn FROM suppliers) WHERE rn = 1),
sr AS (
  SELECT sr1.*, sdet.supplier_name, sdet.country, sdet.payment_terms, sdet.min_order_value,
         CASE WHEN supplier_risk_score > -1 AND supplier_risk_score <= 25 THEN 'Low'
              WHEN supplier_risk_score > 25 AND supplier_risk_score <= 50 THEN 'Medium'
              WHEN supplier_risk_score > 50 AND supplier_risk_score <= 75 THEN 'High'
              WHEN supplier_risk_score > 75 AND supplier_risk_score <= 100 THEN 'Critical' END AS risk_level
  FROM sr1 LEFT JOIN sdet ON sr1.supplier_id = sdet.supplier_id)"""

_SR = ["supplier_id", "supplier_inventory_value", "supplier_skus", "avg_lead_time", "avg_lead_time_std",
       "avg_on_time_rate", "avg_defect_rate", "critical_skus", "high_risk_skus", "recommended_order_value",
       "avg_unit_cost", "supplier_risk_score", "supplier_name", "country", "payment_terms", "min_order_value",
       "risk_level"]
_SR_D = ["supplier_inventory_value", "avg_lead_time", "avg_lead_time_std", "avg_on_time_rate", "avg_defect_rate",
         "recommended_order_value", "avg_unit_cost", "supplier_risk_score", "min_order_value"]
ORACLES["supplier_risk"] = with_model_ctes(SUPPLIER_RISK, f"SELECT {cols(_SR, None, 4, _SR_D)} FROM sr")

MCDA = f"""mc0 AS (SELECT *, (SELECT max(avg_unit_cost) FROM sr) AS max_p, (SELECT min(avg_unit_cost) FROM sr) AS min_p,
                   (SELECT max(avg_lead_time) FROM sr) AS max_l, (SELECT min(avg_lead_time) FROM sr) AS min_l FROM sr),
mc1 AS (SELECT *, CASE WHEN max_p <> min_p THEN (max_p - avg_unit_cost) * 100 / (max_p - min_p) ELSE {dbl(100)} END AS score_price,
               CASE WHEN max_l <> min_l THEN (max_l - avg_lead_time) * 100 / (max_l - min_l) ELSE {dbl(100)} END AS score_speed,
               avg_on_time_rate * 100 AS score_reliability, ({dbl(1)} - avg_defect_rate) * 100 AS score_quality FROM mc0),
mc AS (SELECT *, (score_price * {dbl(0.3)} + score_speed * {dbl(0.2)} + score_reliability * {dbl(0.3)}
                  + score_quality * {dbl(0.2)}) / {dbl(1.0)} AS mcda_score FROM mc1)"""
_MC = ["supplier_id", "supplier_name", "mcda_score", "score_price", "score_speed", "score_reliability", "score_quality",
       "avg_unit_cost", "avg_lead_time", "avg_on_time_rate", "avg_defect_rate", "risk_level"]
ORACLES["supplier_mcda"] = with_model_ctes(SUPPLIER_RISK + ",\n" + MCDA, "SELECT " + ", ".join(
    (f"{r(dr(n, 2))} AS {n}" if n not in ("supplier_id", "supplier_name", "risk_level") else n) for n in _MC) + " FROM mc")

ORACLES["returns_totals"] = with_roles(f"""
SELECT {r('coalesce(sum(refund_amount), 0.0)')} AS total_refund_value,
       CAST(trunc(coalesce(sum(return_qty), 0.0)) AS BIGINT) AS total_returns_qty FROM returns""")

ORACLES["returns_by_reason"] = with_roles(f"""
SELECT reason, {r('sum(return_qty)')} AS return_qty, {r('sum(refund_amount)')} AS refund_amount, count(return_qty) AS cases
FROM returns GROUP BY reason""")

ORACLES["sku_return_rate"] = with_model_ctes(SKU_FIRST + """,
rt AS (SELECT sku, sum(return_qty) AS total_return_qty, sum(refund_amount) AS total_refund_amount FROM returns GROUP BY sku),
sold AS (SELECT sku, sum(qty) AS total_sales_qty FROM sales GROUP BY sku),
j AS (SELECT sf.sku, sf.product, sf.supplier_id, sf.supplier_name, sf.unit_cost,
             coalesce(rt.total_return_qty, 0.0) AS total_return_qty, coalesce(rt.total_refund_amount, 0.0) AS total_refund_amount,
             coalesce(sold.total_sales_qty, 0.0) AS total_sales_qty
      FROM sf LEFT JOIN rt ON sf.sku = rt.sku LEFT JOIN sold ON sf.sku = sold.sku)""", f"""
SELECT sku, product, supplier_id, supplier_name, {r('unit_cost', 6)} AS unit_cost, {r('total_return_qty', 6)} AS total_return_qty,
       {r('total_refund_amount', 6)} AS total_refund_amount, {r('total_sales_qty', 6)} AS total_sales_qty,
       {r('CASE WHEN total_sales_qty > 0 THEN least(greatest(total_return_qty / total_sales_qty, 0.0), 1.0) ELSE 0.0 END', 6)} AS return_rate
FROM j""")

ORACLES["supplier_returns"] = with_model_ctes(SKU_FIRST + ",\n" + SUPPLIER_RISK + """,
rs AS (SELECT r.*, sf.supplier_id, sf.supplier_name FROM returns r LEFT JOIN sf ON r.sku = sf.sku),
agg2 AS (SELECT supplier_id, supplier_name, sum(return_qty) AS supplier_return_qty, sum(refund_amount) AS supplier_refund_amount,
                CAST(trunc(coalesce(sum(CASE WHEN reason IN ('quality_issue', 'damaged') THEN return_qty END), 0.0)) AS BIGINT) AS supplier_quality_return_qty
         FROM rs WHERE supplier_id IS NOT NULL AND supplier_name IS NOT NULL GROUP BY supplier_id, supplier_name)""", f"""
SELECT a.supplier_id, a.supplier_name, {r('a.supplier_return_qty', 6)} AS supplier_return_qty,
       {r('a.supplier_refund_amount', 6)} AS supplier_refund_amount, a.supplier_quality_return_qty,
       {r('sr.avg_defect_rate', 6)} AS avg_defect_rate
FROM agg2 a LEFT JOIN sr ON a.supplier_id = sr.supplier_id""")

ORACLES["overall_return_rate"] = with_roles(f"""
SELECT t.total_returns_qty, {r('coalesce(s.total_sales_qty, 1.0)', 8)} AS total_sales_qty,
       {r('CASE WHEN coalesce(s.total_sales_qty, 1.0) > 0 THEN t.total_returns_qty / coalesce(s.total_sales_qty, 1.0) ELSE 0.0 END', 8)} AS return_rate
FROM (SELECT CAST(trunc(coalesce(sum(return_qty), 0.0)) AS BIGINT) AS total_returns_qty FROM returns) t,
     (SELECT sum(qty) AS total_sales_qty FROM sales) s""")

TRANSFERS = f"""sides AS (
  SELECT sku, product, warehouse, unit_cost, annual_revenue,
         CASE WHEN stock < safety_stock THEN safety_stock - stock ELSE 0.0 END AS deficit,
         CASE WHEN stock >= safety_stock AND stock > reorder_point THEN stock - reorder_point ELSE 0.0 END AS surplus
  FROM base),
bothk AS (SELECT sku FROM sides GROUP BY sku HAVING count(*) >= 2 AND max(deficit) > 0 AND max(surplus) > 0),
cand AS (SELECT *, floor(deficit) AS d, floor(surplus) AS sv FROM sides
         WHERE sku IN (SELECT sku FROM bothk) AND (SELECT count(DISTINCT warehouse) FROM base) > 1),
dl AS (SELECT *, sum(d) OVER (PARTITION BY sku ORDER BY annual_revenue DESC, product, warehouse
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM cand WHERE d >= 1),
sl AS (SELECT *, sum(sv) OVER (PARTITION BY sku ORDER BY annual_revenue DESC, product, warehouse
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM cand WHERE sv >= 1),
tr AS (SELECT dl.sku, dl.product, sl.warehouse AS from_warehouse, dl.warehouse AS to_warehouse,
              least(dl.hi, sl.hi) - greatest(dl.hi - dl.d, sl.hi - sl.sv) AS q, dl.unit_cost
       FROM dl JOIN sl ON dl.sku = sl.sku WHERE least(dl.hi, sl.hi) - greatest(dl.hi - dl.d, sl.hi - sl.sv) >= 1)"""
ORACLES["transfers_whole_units"] = with_model_ctes(TRANSFERS, f"""
SELECT sku, product, from_warehouse, to_warehouse, CAST(q AS BIGINT) AS qty, {r('unit_cost')} AS unit_cost,
       {r('q * unit_cost')} AS saved_value FROM tr""")

# the greedy as a recursion: the first open deficit meets the first open
# surplus; an amount below one unit is passed over for good
WALK = TRANSFERS[:TRANSFERS.index("dl AS (")] + """dq AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY annual_revenue DESC, product, warehouse) AS k FROM cand WHERE deficit >= 1),
sq_ AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY annual_revenue DESC, product, warehouse) AS k FROM cand WHERE surplus >= 1),
walk AS (
  SELECT dq.sku, dq.k AS i, sq_.k AS j, dq.deficit AS d, sq_.surplus AS s FROM dq JOIN sq_ ON dq.sku = sq_.sku AND dq.k = 1 AND sq_.k = 1
  UNION ALL
  SELECT w.sku, a.k, b.k, CASE WHEN a.k = w.i THEN w.d - least(w.d, w.s) ELSE a.deficit END,
         CASE WHEN b.k = w.j THEN w.s - least(w.d, w.s) ELSE b.surplus END
  FROM walk w
  JOIN dq a ON a.sku = w.sku AND a.k = w.i + CASE WHEN w.d - least(w.d, w.s) < 1 THEN 1 ELSE 0 END
  JOIN sq_ b ON b.sku = w.sku AND b.k = w.j + CASE WHEN w.s - least(w.d, w.s) < 1 THEN 1 ELSE 0 END),
tr AS (SELECT w.sku, dq.product, sq_.warehouse AS from_warehouse, dq.warehouse AS to_warehouse, least(w.d, w.s) AS q, dq.unit_cost
       FROM walk w JOIN dq ON dq.sku = w.sku AND dq.k = w.i JOIN sq_ ON sq_.sku = w.sku AND sq_.k = w.j)"""


def with_walk(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + model_sql() + ",\n" + ",\n".join(ctes) + "\n" + select


_MOVED = f"""
SELECT sku, product, from_warehouse, to_warehouse, CAST(round_even(q, 0) AS BIGINT) AS qty, {r('unit_cost')} AS unit_cost,
       {r('q * unit_cost')} AS saved_value FROM tr"""
ORACLES["transfers_exact"] = with_walk([WALK], _MOVED)
ORACLES["top_transfers"] = with_walk([WALK], _MOVED + " ORDER BY q * unit_cost DESC, sku, from_warehouse, to_warehouse LIMIT 15")

ORACLES["transfer_summary"] = with_walk([WALK], f"""
SELECT {r('coalesce(sum(q * unit_cost), 0.0)', 3)} AS saved_transfer_value, count(*) AS transfers_count FROM tr""")

_LEVELS = "(VALUES " + ", ".join(f"({dbl(x)})" for x in (0.80, 0.85, 0.90, 0.95, 0.98, 0.99)) + ") lv(service_level)"
Z_CASE = ("CASE WHEN service_level >= 0.99 THEN 2.33 WHEN service_level >= 0.98 THEN 2.05 WHEN service_level >= 0.95 THEN 1.65 "
          "WHEN service_level >= 0.90 THEN 1.28 WHEN service_level >= 0.85 THEN 1.04 ELSE 0.84 END")
CURVES = f"""cc AS (
  SELECT service_level,
         sum(CAST({Z_CASE} AS DOUBLE) * std_daily_demand * sqrt(greatest({dbl(1)}, lead_time_days)) * unit_cost * {dbl(0.22)}) AS carrying_cost,
         sum(({dbl(1)} - service_level) * annual_demand_qty * greatest({dbl(1)}, unit_cost * {dbl(1.5)})) AS stockout_cost
  FROM base, {_LEVELS} GROUP BY service_level)"""
ORACLES["cost_curves"] = with_model_ctes(CURVES, f"""
SELECT {r('service_level', 2)} AS service_level, {r('carrying_cost', 2)} AS carrying_cost, {r('stockout_cost', 2)} AS stockout_cost,
       {r('carrying_cost + stockout_cost', 2)} AS total_cost FROM cc""")
ORACLES["optimal_service_level"] = with_model_ctes(CURVES, f"""
SELECT {r('service_level', 2)} AS service_level, {r('carrying_cost', 2)} AS carrying_cost, {r('stockout_cost', 2)} AS stockout_cost,
       {r('carrying_cost + stockout_cost', 2)} AS total_cost FROM cc ORDER BY carrying_cost + stockout_cost, service_level LIMIT 1""")

FREIGHT = f"""f0 AS (
  SELECT sku, product, warehouse, greatest(annual_demand_qty, {dbl(0)}) AS annual_demand, unit_cost,
         greatest(lead_time_days, {dbl(1)}) AS lead_time_ocean,
         {dr(f'greatest({dbl(3)}, lead_time_days * {dbl(0.25)})', 1)} AS lead_time_air,
         {dr(f'unit_cost * {dbl(0.08)} + {dbl(0.5)}', 2)} AS freight_cost_ocean_unit,
         {dr(f'unit_cost * {dbl(0.3)} + {dbl(4.0)}', 2)} AS freight_cost_air_unit,
         std_daily_demand, holding_cost_rate FROM base),
f1 AS (
  SELECT *, annual_demand * freight_cost_ocean_unit AS annual_freight_ocean,
         annual_demand * freight_cost_air_unit AS annual_freight_air,
         {dbl(1.65)} * std_daily_demand * sqrt(lead_time_ocean) * (unit_cost * holding_cost_rate) AS carrying_cost_ocean,
         {dbl(1.65)} * std_daily_demand * sqrt(lead_time_air) * (unit_cost * holding_cost_rate) AS carrying_cost_air,
         annual_demand * (unit_cost * holding_cost_rate) * (lead_time_ocean / {dbl(365)}) AS pipeline_cost_ocean,
         annual_demand * (unit_cost * holding_cost_rate) * (lead_time_air / {dbl(365)}) AS pipeline_cost_air FROM f0),
f2 AS (SELECT *, annual_freight_ocean + carrying_cost_ocean + pipeline_cost_ocean AS total_cost_ocean,
              annual_freight_air + carrying_cost_air + pipeline_cost_air AS total_cost_air FROM f1),
fr2 AS (SELECT *, CASE WHEN total_cost_air < total_cost_ocean THEN 'Air' ELSE 'Ocean' END AS recommended_mode,
               abs(total_cost_air - total_cost_ocean) AS cost_difference FROM f2)"""
_FR = ["sku", "product", "annual_demand", "unit_cost", "lead_time_ocean", "lead_time_air", "freight_cost_ocean_unit",
       "freight_cost_air_unit", "warehouse", "annual_freight_ocean", "annual_freight_air", "carrying_cost_ocean",
       "carrying_cost_air", "pipeline_cost_ocean", "pipeline_cost_air", "total_cost_ocean", "total_cost_air",
       "recommended_mode", "cost_difference"]
ORACLES["freight_modes"] = with_model_ctes(FREIGHT, "SELECT " + ", ".join(
    (n if n in ("sku", "product", "warehouse", "recommended_mode") else f"{r(n)} AS {n}") for n in _FR) + " FROM fr2")
ORACLES["freight_portfolio"] = with_model_ctes(FREIGHT, f"""
SELECT CAST(sum(CASE WHEN recommended_mode = 'Air' THEN 1 ELSE 0 END) AS BIGINT) AS air_count,
       CAST(sum(CASE WHEN recommended_mode = 'Air' THEN 0 ELSE 1 END) AS BIGINT) AS ocean_count,
       {r('sum(total_cost_ocean)', 2)} AS total_ocean_scenario, {r('sum(total_cost_air)', 2)} AS total_air_scenario,
       {r("sum(CASE WHEN recommended_mode = 'Air' THEN total_cost_air ELSE total_cost_ocean END)", 2)} AS optimized_cost,
       {r("coalesce(sum(CASE WHEN recommended_mode = 'Air' THEN total_cost_ocean - total_cost_air END), 0.0)", 2)} AS savings
FROM fr2""")
ORACLES["freight_long"] = with_model_ctes(FREIGHT + """,
top10 AS (SELECT * FROM fr2 ORDER BY annual_demand DESC, sku, product, warehouse LIMIT 10)""", f"""
SELECT sku, product, warehouse, 'Ocean (Bulk)' AS mode, {r('total_cost_ocean')} AS annual_cost FROM top10
UNION ALL SELECT sku, product, warehouse, 'Air (Express)' AS mode, {r('total_cost_air')} AS annual_cost FROM top10""")

FIN = f"""fin0 AS (
  SELECT sku, product, storage_class, warehouse, greatest(annual_demand_qty * unit_cost, {dbl(0)}) AS annual_cogs,
         greatest(greatest(safety_stock + eoq / {dbl(2)}, stock) * unit_cost, {dbl(0)}) AS average_inventory_value,
         holding_cost_rate FROM base),
fin1 AS (SELECT *, CASE WHEN average_inventory_value > 0 THEN annual_cogs / average_inventory_value ELSE {dbl(0)} END AS itr FROM fin0),
fin AS (SELECT *, least(CASE WHEN itr > 0 THEN {dbl(365)} / itr ELSE {dbl(365)} END, {dbl(365)}) AS dio,
               average_inventory_value * holding_cost_rate AS annual_carrying_cost FROM fin1)"""
ORACLES["financial_velocity"] = with_model_ctes(FIN, f"""
SELECT sku, product, storage_class, warehouse, {r('annual_cogs')} AS annual_cogs, {r('average_inventory_value')} AS average_inventory_value,
       {r('itr')} AS itr, {r('dio')} AS dio, {r('annual_carrying_cost')} AS annual_carrying_cost FROM fin""")
ORACLES["finance_by_class"] = with_model_ctes(FIN, f"""
SELECT storage_class, count(sku) AS sku_count, {r('sum(annual_cogs)', 3)} AS annual_cogs,
       {r('sum(average_inventory_value)', 3)} AS total_avg_inventory_value,
       {r('sum(annual_carrying_cost)', 3)} AS total_annual_carrying_cost FROM fin GROUP BY storage_class""")
PORT = """pt AS (SELECT coalesce(sum(annual_cogs), 0.0) AS total_annual_cogs, coalesce(sum(average_inventory_value), 0.0) AS total_avg_inventory_value,
              coalesce(sum(annual_carrying_cost), 0.0) AS total_annual_carrying_cost FROM fin)"""
ORACLES["portfolio_ratios"] = with_model_ctes(FIN + ",\n" + PORT, f"""
SELECT {r('total_annual_cogs', 3)} AS total_annual_cogs, {r('total_avg_inventory_value', 3)} AS total_avg_inventory_value,
       {r('total_annual_carrying_cost', 3)} AS total_annual_carrying_cost,
       {r('CASE WHEN total_avg_inventory_value > 0 THEN total_annual_cogs / total_avg_inventory_value ELSE 0.0 END', 3)} AS portfolio_itr,
       {r('CASE WHEN total_annual_cogs > 0 THEN 365.0 * total_avg_inventory_value / total_annual_cogs ELSE 365.0 END', 3)} AS portfolio_dio
FROM pt""")

ORACLES["kpis"] = with_walk([SUPPLIER_RISK, WALK, FIN, PORT], f"""
SELECT {r('coalesce(sum(inventory_value), 0.0)', 3)} AS total_inventory_value,
       {r('coalesce(sum(CASE WHEN recommended_order_qty > 0 THEN recommended_order_value END), 0.0)', 3)} AS recommended_order_value,
       count(CASE WHEN stockout_risk = 'Critical' THEN 1 END) AS critical_skus,
       count(CASE WHEN stockout_risk IN ('Critical', 'High') THEN 1 END) AS high_risk_skus,
       count(CASE WHEN dead_stock_flag THEN 1 END) AS dead_stock_skus,
       count(CASE WHEN overstock_flag THEN 1 END) AS overstock_skus,
       (SELECT count(CASE WHEN risk_level IN ('Critical', 'High') THEN 1 END) FROM sr) AS supplier_high_risk,
       CAST(30 AS BIGINT) AS forecast_horizon_days, {r(dbl(0.95), 2)} AS service_level,
       {r('(SELECT coalesce(sum(refund_amount), 0.0) FROM returns)', 2)} AS total_refund_value,
       (SELECT CAST(trunc(coalesce(sum(return_qty), 0.0)) AS BIGINT) FROM returns) AS total_returns_qty,
       {r('(SELECT coalesce(sum(q * unit_cost), 0.0) FROM tr)', 3)} AS saved_transfer_value,
       (SELECT count(*) FROM tr) AS transfers_count,
       {r('(SELECT total_annual_cogs FROM pt)', 2)} AS total_annual_cogs,
       {r('(SELECT total_avg_inventory_value FROM pt)', 2)} AS total_avg_inventory_value,
       {r('(SELECT CASE WHEN total_avg_inventory_value > 0 THEN total_annual_cogs / total_avg_inventory_value ELSE 0.0 END FROM pt)', 2)} AS portfolio_itr,
       {r('(SELECT CASE WHEN total_annual_cogs > 0 THEN 365.0 * total_avg_inventory_value / total_annual_cogs ELSE 365.0 END FROM pt)', 2)} AS portfolio_dio,
       {r('(SELECT total_annual_carrying_cost FROM pt)', 2)} AS total_annual_carrying_cost
FROM base""")

# ---- alerts, documents --------------------------------------------------
NL = " || chr(10) || "


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fmt2(x: str) -> str:
    return f"format('{{:,.2f}}', {dr(x, 6)})"


def fmt1(x: str) -> str:
    return f"CASE WHEN isinf({x}) THEN 'inf' ELSE format('{{:.1f}}', {dr(x, 6)}) END"


def int_s(x: str) -> str:
    return f"CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR)"


ALERT_CTES = f"""so AS (SELECT *, row_number() OVER (ORDER BY annual_revenue DESC, sku, product, warehouse) AS rk
       FROM base WHERE stockout_risk IN ('Critical', 'High')),
sa AS (SELECT *, row_number() OVER (ORDER BY supplier_risk_score DESC, supplier_id) AS rk
       FROM sr WHERE risk_level IN ('High', 'Critical')),
da AS (SELECT *, row_number() OVER (ORDER BY annual_revenue DESC, sku, product, warehouse) AS rk FROM base WHERE dead_stock_flag),
ta AS (SELECT count(*) AS n, sum(q * unit_cost) AS v FROM tr),
alerts AS (
  SELECT 1 AS alert_group, CAST(rk AS BIGINT) AS rank, 'stockout_risk' AS type,
         CASE WHEN stockout_risk = 'Critical' THEN 'P1' ELSE 'P2' END AS priority, sku, CAST(NULL AS VARCHAR) AS supplier_id,
         product || ' has ' || stockout_risk || ' stockout risk with ' || {fmt1('days_of_cover')} || ' days of cover.' AS message,
         'Order ' || {int_s('recommended_order_qty')} || ' units from ' || coalesce(supplier_name, supplier_id) || '.' AS recommended_action
  FROM so
  UNION ALL
  SELECT 2, CAST(rk AS BIGINT), 'supplier_risk', CASE WHEN risk_level = 'Critical' THEN 'P1' ELSE 'P2' END, CAST(NULL AS VARCHAR),
         supplier_id,
         'Supplier ' || coalesce(supplier_name, supplier_id) || ' has ' || risk_level || ' risk score '
           || CAST(supplier_risk_score AS VARCHAR) || '.',
         {sq("Review alternate suppliers, open PO ETAs, and quality issues before new large orders.")}
  FROM sa
  UNION ALL
  SELECT 3, CAST(rk AS BIGINT), 'dead_stock', 'P3', sku, CAST(NULL AS VARCHAR),
         product || ' has stock but almost no recent demand.',
         {sq("Consider markdown, bundle, ad campaign, or stop replenishment.")}
  FROM da
  UNION ALL
  SELECT 4, CAST(1 AS BIGINT), 'warehouse_transfer', 'P3', 'Multiple', CAST(NULL AS VARCHAR),
         'Found ' || CAST(n AS VARCHAR) || ' internal stock transfer opportunities to reduce purchasing cost by '
           || {fmt2('v')} || '.',
         {sq("Review the Inter-DC Transfer Advisor tab to approve internal inventory routing.")}
  FROM ta WHERE n > 0)"""

ORACLES["alerts"] = with_walk([SUPPLIER_RISK, WALK, ALERT_CTES], "SELECT * FROM alerts")
ORACLES["alerts_top"] = with_walk([SUPPLIER_RISK, WALK, ALERT_CTES], """SELECT * FROM alerts
WHERE rank <= CASE alert_group WHEN 1 THEN 40 WHEN 2 THEN 20 WHEN 3 THEN 20 ELSE 1 END""")

PLAN_ORDER = "stockout_risk, recommended_order_value DESC, annual_revenue DESC, sku, product, warehouse"
_HEAD = NL.join(sq(x) for x in ["Subject: Reorder Approval Request", "", "Hi team,", "",
                                "Please review the following reorder recommendations before purchase approval:", ""])
_TAIL = NL.join(sq(x) for x in ["Please confirm budget, supplier ETA, and any open purchase orders before releasing this order.",
                                "", "Regards,", "Operations"])
ORACLES["procurement_drafts"] = with_model_ctes(f"""
plan AS (SELECT * FROM base WHERE recommended_order_qty > 0),
ln AS (SELECT supplier_id,
              '- ' || sku || ' / ' || product || ': ' || {int_s('recommended_order_qty')} || ' units, risk ' || stockout_risk
                || ', estimated value ' || {fmt2('recommended_order_value')} AS line,
              row_number() OVER (PARTITION BY supplier_id ORDER BY {PLAN_ORDER}) AS rk,
              row_number() OVER (ORDER BY {PLAN_ORDER}) AS grk
       FROM plan),
body AS (SELECT supplier_id, string_agg(line, chr(10) ORDER BY rk) AS body FROM ln WHERE rk <= 20 GROUP BY supplier_id
         UNION ALL SELECT 'All suppliers', string_agg(line, chr(10) ORDER BY grk) FROM ln WHERE grk <= 20),
tot AS (SELECT supplier_id, sum(recommended_order_value) AS total FROM plan GROUP BY supplier_id
        UNION ALL SELECT 'All suppliers', sum(recommended_order_value) FROM plan)""", f"""
SELECT b.supplier_id, {_HEAD}{NL}b.body{NL}''{NL}'Estimated order value: ' || {fmt2('t.total')}{NL}''{NL}{_TAIL} AS draft
FROM body b JOIN tot t ON b.supplier_id = t.supplier_id""")

ORACLES["procurement_draft_lines"] = with_model(f"""
SELECT supplier_id, CAST(row_number() OVER (PARTITION BY supplier_id ORDER BY {PLAN_ORDER}) AS BIGINT) AS rank,
       '- ' || sku || ' / ' || product || ': ' || {int_s('recommended_order_qty')} || ' units, risk ' || stockout_risk
         || ', estimated value ' || {fmt2('recommended_order_value')} AS line
FROM base WHERE recommended_order_qty > 0""")

_RFQ = NL.join([
    "'Subject: Request for Quote (RFQ) - ' || product || ' (' || sku || ')'", "''",
    "'Dear ' || coalesce(supplier_name, supplier_id) || ' Team,'", "''",
    sq("We would like to request a formal quotation for the purchase of the following items:"), "''",
    "'- Product Name: ' || product", "'- SKU: ' || sku",
    "'- Order Quantity: ' || format('{:,}', qty) || ' units'",
    f"CASE WHEN unit_cost > 0 THEN '- Target Unit Price: $' || {fmt2('unit_cost')} ELSE '- Target Unit Price: Competitive Market Rate' END",
    "'- Requested Delivery Date: ' || strftime((SELECT hi FROM anchor) + 20, '%Y-%m-%d')", "''",
    sq("Please confirm your capacity to supply this quantity, your standard lead time, payment terms, and total pricing including shipping terms (FOB/DDP)."),
    "''", sq("We look forward to your prompt response."), "''", sq("Best regards,"), sq("Procurement Team")])
ORACLES["rfq_drafts"] = with_model_ctes(FIRST_ROWS + """,
fq AS (SELECT *, CASE WHEN recommended_order_qty > 0 THEN CAST(trunc(recommended_order_qty) AS BIGINT) ELSE CAST(100 AS BIGINT) END AS qty FROM fr)""",
    f"SELECT sku, coalesce(supplier_name, supplier_id) AS supplier_name, qty, {_RFQ} AS rfq FROM fq")


def _const(section: int, texts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {section} AS section, CAST({i + 1} AS BIGINT) AS item, {sq(t)} AS text"
                              for i, t in enumerate(texts))


KPI_LINES = [
    f"'- Inventory value under review: **' || {fmt2('total_inventory_value')} || '**.'",
    f"'- Recommended reorder value: **' || {fmt2('recommended_order_value')} || '**.'",
    "'- Critical SKUs: **' || CAST(critical_skus AS VARCHAR) || '**.'",
    "'- High/Critical stockout SKUs: **' || CAST(high_risk_skus AS VARCHAR) || '**.'",
    "'- Dead-stock candidates: **' || CAST(dead_stock_skus AS VARCHAR) || '**.'",
    "'- High-risk suppliers: **' || CAST(supplier_high_risk AS VARCHAR) || '**.'",
]
ORACLES["report_lines"] = with_walk([SUPPLIER_RISK, WALK, ALERT_CTES, f"""
kk AS (SELECT coalesce(sum(inventory_value), 0.0) AS total_inventory_value,
              coalesce(sum(CASE WHEN recommended_order_qty > 0 THEN recommended_order_value END), 0.0) AS recommended_order_value,
              count(CASE WHEN stockout_risk = 'Critical' THEN 1 END) AS critical_skus,
              count(CASE WHEN stockout_risk IN ('Critical', 'High') THEN 1 END) AS high_risk_skus,
              count(CASE WHEN dead_stock_flag THEN 1 END) AS dead_stock_skus,
              (SELECT count(CASE WHEN risk_level IN ('Critical', 'High') THEN 1 END) FROM sr) AS supplier_high_risk FROM base),
tp AS (SELECT *, row_number() OVER (ORDER BY {PLAN_ORDER}) AS rk FROM base WHERE recommended_order_qty > 0),
ts AS (SELECT *, row_number() OVER (ORDER BY supplier_risk_score DESC, supplier_id) AS rk FROM sr),
ta2 AS (SELECT *, row_number() OVER (ORDER BY alert_group, rank) AS pos FROM alerts
        WHERE rank <= CASE alert_group WHEN 1 THEN 40 WHEN 2 THEN 20 WHEN 3 THEN 20 ELSE 1 END)"""], f"""
{_const(0, ["# Supply Chain Executive Report", "", "## Executive Summary"])}
UNION ALL {" UNION ALL ".join(f"SELECT 1, CAST({i + 1} AS BIGINT), {t} FROM kk" for i, t in enumerate(KPI_LINES))}
UNION ALL {_const(2, [""])}
UNION ALL {_const(4, ["## Top Reorder Recommendations"])}
UNION ALL SELECT 5, CAST(rk AS BIGINT), '- **' || sku || ' / ' || product || '**: order **' || {int_s('recommended_order_qty')}
    || '** units; risk: **' || stockout_risk || '**; estimated value: **' || {fmt2('recommended_order_value')} || '**.' FROM tp WHERE rk <= 10
UNION ALL SELECT 5, CAST(1 AS BIGINT), 'No reorder recommendations were generated.' WHERE (SELECT count(*) FROM tp) = 0
UNION ALL {_const(6, ["", "## Supplier Risk Watchlist"])}
UNION ALL SELECT 7, CAST(rk AS BIGINT), '- **' || coalesce(supplier_name, supplier_id) || '**: risk score **'
    || CAST(supplier_risk_score AS VARCHAR) || '** (' || coalesce(risk_level, 'nan') || '); high-risk SKUs: **'
    || CAST(high_risk_skus AS VARCHAR) || '**.' FROM ts WHERE rk <= 8
UNION ALL SELECT 7, CAST(1 AS BIGINT), 'No supplier risk data available.' WHERE (SELECT count(*) FROM ts) = 0
UNION ALL {_const(8, ["", "## Recommended Operating Actions"])}
UNION ALL SELECT 9, CAST(pos AS BIGINT), '- **' || priority || ' / ' || type || '**: ' || message || ' Action: ' || recommended_action
    FROM ta2 WHERE pos <= 15
UNION ALL {_const(10, ["", "## Governance Notes",
                       "- Treat recommendations as decision support, not automatic purchase approval.",
                       "- Review supplier contracts, cash limits, lead-time assumptions, and current open POs before placing orders.",
                       "- Use approval gates for procurement emails, PO creation, and budget-impacting changes."])}""")

# ---- scenarios ----------------------------------------------------------
def _scenario_values() -> str:
    from replenish.operators.scenarios import grid
    return "(VALUES " + ", ".join(f"({sq(s.name)}, {dbl(s.demand_multiplier)}, {dbl(s.lead_time_delay)}, {dbl(s.service_level)})"
                                  for s in grid()) + ") sc(name, m, d, sl)"


SCEN = f"""x0 AS (SELECT p.*, sc.name, sc.m, sc.d, sc.sl FROM position p, {_scenario_values()}),
x1 AS (SELECT * REPLACE (avg_daily_demand * m AS avg_daily_demand, std_daily_demand * m AS std_daily_demand,
                         lead_time_days + d AS lead_time_days) FROM x0),
x2 AS (SELECT *,
         CAST(CASE WHEN sl >= 0.99 THEN 2.33 WHEN sl >= 0.98 THEN 2.05 WHEN sl >= 0.95 THEN 1.65 WHEN sl >= 0.90 THEN 1.28
                   WHEN sl >= 0.85 THEN 1.04 ELSE 0.84 END AS DOUBLE) * std_daily_demand * sqrt(greatest(lead_time_days, {dbl(1)})) AS safety_stock,
         CASE WHEN storage_class = 'fragile' THEN {dbl(0.28)} WHEN storage_class = 'cold-chain' THEN {dbl(0.35)} ELSE {dbl(0.22)} END AS holding_cost_rate,
         CASE WHEN avg_daily_demand > 0 THEN stock / avg_daily_demand ELSE CAST('inf' AS DOUBLE) END AS days_of_cover,
         stock + incoming_qty AS net_position FROM x1),
x3 AS (SELECT *, avg_daily_demand * lead_time_days + safety_stock AS reorder_point,
         sqrt({dbl(2)} * greatest(annual_demand_qty, {dbl(0)}) * {dbl(35.0)}
              / greatest(holding_cost_rate * (CASE WHEN unit_cost = 0 THEN {dbl(1)} ELSE unit_cost END), {dbl(0.01)})) AS eoq FROM x2),
x4 AS (SELECT *, greatest(reorder_point - net_position, {dbl(0)}) AS shortage_qty FROM x3),
x5 AS (SELECT *,
         {dr("greatest(" + dr(f"greatest(shortage_qty, CASE WHEN shortage_qty > 0 THEN eoq ELSE {dbl(0)} END)", 0) + f", CASE WHEN shortage_qty > 0 THEN min_order_qty ELSE {dbl(0)} END)", 0)} AS recommended_order_qty,
         CASE WHEN avg_daily_demand <= 0 AND stock > 0 THEN 'Dead-stock risk'
              WHEN days_of_cover <= greatest({dbl(3)}, lead_time_days * {dbl(0.35)}) THEN 'Critical'
              WHEN net_position < reorder_point THEN 'High'
              WHEN days_of_cover <= lead_time_days + 7 THEN 'Medium' ELSE 'Low' END AS stockout_risk FROM x4),
scen AS (SELECT name, any_value(m) AS demand_multiplier, any_value(d) AS lead_time_delay, any_value(sl) AS service_level,
                sum(stock * unit_cost) AS total_inventory_value,
                coalesce(sum(CASE WHEN recommended_order_qty > 0 THEN recommended_order_qty * unit_cost END), 0.0) AS recommended_order_value,
                count(CASE WHEN stockout_risk = 'Critical' THEN 1 END) AS critical_skus
         FROM x5 GROUP BY name)"""
ORACLES["scenario_grid"] = with_model_ctes(SCEN, f"""
SELECT name, {r('demand_multiplier', 2)} AS demand_multiplier, {r('lead_time_delay', 2)} AS lead_time_delay,
       {r('service_level', 2)} AS service_level, {r('total_inventory_value', 3)} AS total_inventory_value,
       {r('recommended_order_value', 3)} AS recommended_order_value, critical_skus FROM scen""")
ORACLES["scenario_long"] = with_model_ctes(SCEN, f"""
SELECT name, 'total_inventory_value' AS metric, {r('total_inventory_value', 3)} AS value FROM scen
UNION ALL SELECT name, 'recommended_order_value', {r('recommended_order_value', 3)} FROM scen""")

# ---- playbook watches ---------------------------------------------------
ORACLES["stockout_watch"] = with_model(f"""
SELECT sku, product, warehouse, supplier_id, stockout_risk, {r('days_of_cover')} AS days_of_cover,
       {r('recommended_order_qty')} AS recommended_order_qty, {r('recommended_order_value')} AS recommended_order_value
FROM base WHERE stockout_risk IN ('Critical', 'High')""")

ORACLES["supplier_delay_watch"] = with_model_ctes(SUPPLIER_RISK + """,
opo AS (SELECT p.*, sr.supplier_risk_score FROM pos p LEFT JOIN sr ON p.supplier_id = sr.supplier_id
        WHERE p.status NOT IN ('closed', 'cancelled', 'received', 'complete', 'completed')),
w AS (SELECT *, expected_date < (SELECT hi FROM anchor) AS eta_breached,
             coalesce(supplier_risk_score > 75, false) AS supplier_risky FROM opo)""", f"""
SELECT po_id, sku, supplier_id, status, expected_date, {r('ordered_qty')} AS ordered_qty,
       {r('supplier_risk_score')} AS supplier_risk_score, eta_breached, supplier_risky
FROM w WHERE eta_breached OR supplier_risky""")

ORACLES["dead_stock_cleanup"] = with_model(f"""
SELECT sku, product, warehouse, {r('stock')} AS stock, {r('days_of_cover')} AS days_of_cover,
       {r('avg_daily_demand')} AS avg_daily_demand, {r('inventory_value')} AS inventory_value
FROM base WHERE days_of_cover > 90 OR avg_daily_demand < 0.2""")

ORACLES["budget_guardrail"] = with_model_ctes("""
bg AS (SELECT supplier_id, sum(recommended_order_value) AS order_value FROM base WHERE recommended_order_qty > 0 GROUP BY supplier_id
       UNION ALL SELECT 'ALL', coalesce(sum(recommended_order_value), 0.0) FROM base WHERE recommended_order_qty > 0)""", f"""
SELECT supplier_id, {r('order_value')} AS order_value, order_value > {dbl(5000.0)} AS needs_finance_approval FROM bg""")

_BOOKS = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if not isinstance(x, bool) else str(x).lower() for x in p) + ")" for p in PLAYBOOKS)
_FLAGS = ["(SELECT count(*) FROM base WHERE stockout_risk IN ('Critical', 'High'))",
          """(SELECT count(*) FROM pos p LEFT JOIN sr ON p.supplier_id = sr.supplier_id
   WHERE p.status NOT IN ('closed', 'cancelled', 'received', 'complete', 'completed')
     AND (expected_date < (SELECT hi FROM anchor) OR coalesce(supplier_risk_score > 75, false)))""",
          "(SELECT count(*) FROM base WHERE days_of_cover > 90 OR avg_daily_demand < 0.2)",
          "(SELECT count(*) FROM spike_hits WHERE rn <= 5)",
          "(SELECT count(*) FROM budget_rows WHERE order_value > 5000)"]
ORACLES["playbook_table"] = with_model_ctes(SUPPLIER_RISK + f""",
budget_rows AS (SELECT supplier_id, sum(recommended_order_value) AS order_value FROM base WHERE recommended_order_qty > 0 GROUP BY supplier_id
                UNION ALL SELECT 'ALL', coalesce(sum(recommended_order_value), 0.0) FROM base WHERE recommended_order_qty > 0),
spike_days AS (SELECT sku, product, date, sum(qty) AS qty FROM sales GROUP BY sku, product, date),
spike_fences AS (SELECT sku, quantile_cont(qty, 0.75) + (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) * {dbl(1.5)} AS upper,
                        avg(qty) + stddev_samp(qty) * 2 AS two_sigma FROM spike_days GROUP BY sku HAVING count(*) >= 10),
spike_hits AS (SELECT d.sku, row_number() OVER (PARTITION BY d.sku ORDER BY product DESC, date DESC) AS rn
               FROM spike_days d JOIN spike_fences f ON d.sku = f.sku WHERE d.qty > greatest(upper, two_sigma)),
books(name, trigger, condition, action, approval_required) AS (VALUES {_BOOKS})""", "SELECT name, trigger, condition, action, approval_required, CASE name " + " ".join(
    f"WHEN '{p[0]}' THEN {f}" for p, f in zip(PLAYBOOKS, _FLAGS)) + " END AS flagged FROM books")

ORACLES["scenario_upsert"] = with_model_ctes(SCEN, f"""
SELECT name, {r('demand_multiplier', 2)} AS demand_multiplier, {r('lead_time_delay', 2)} AS lead_time_delay,
       {r('service_level', 2)} AS service_level, {r('total_inventory_value', 3)} AS total_inventory_value,
       {r('recommended_order_value', 3)} AS recommended_order_value,
       critical_skus + CASE WHEN lead_time_delay > 0 THEN 1000 ELSE 0 END AS critical_skus FROM scen""")

ORACLES["csv_roundtrip"] = ORACLES["std_inventory"]
ORACLES["json_roundtrip"] = ORACLES["std_pos"]
ORACLES["bundle_roundtrip"] = ORACLES["std_suppliers"]
ORACLES["folder_roundtrip"] = ORACLES["std_inventory"]
ORACLES["audit_roundtrip"] = ORACLES["reorder_plan"]
ORACLES["automation_payload"] = ORACLES["alerts"] + " ORDER BY alert_group, rank LIMIT 100"
ORACLES["report_text"] = f"SELECT text FROM ({ORACLES['report_lines']})"

ORACLES["price_fallback_sales"] = f"""
SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS product, {r('sum(l_quantity)')} AS qty, {r('sum(l_quantity * p_retailprice)')} AS revenue,
       count(*) AS rows
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name"""
ORACLES["no_sales_position"] = with_roles(f"""
SELECT sku, product, warehouse, {r('stock')} AS stock, {r('unit_cost')} AS unit_cost, {r('0.0')} AS avg_daily_demand, {r('0.0')} AS annual_demand_qty
FROM inventory""")

_COMPONENTS = ", ".join(f"('{sku}', '{dict((b[1], b[2]) for b in DEMO_BOM)[sku]}', '{wh}', CAST({stock} AS DOUBLE), CAST({cost} AS DOUBLE), '{sup}')"
                        for sku, stock, cost, sup, wh, *_ in DEMO_COMPONENT_STOCK)
_STOCK6 = f"sku, product, warehouse, {r('stock')} AS stock, {r('unit_cost')} AS unit_cost, supplier_id"
ORACLES["demo_bom_position"] = with_roles_ctes(f"demo(sku, product, warehouse, stock, unit_cost, supplier_id) AS (VALUES {_COMPONENTS})", f"""
SELECT {_STOCK6} FROM inventory UNION ALL SELECT {_STOCK6} FROM demo WHERE sku NOT IN (SELECT sku FROM inventory)""")
ORACLES["compat_columns"] = with_roles(f"SELECT {_STOCK6} FROM inventory")
ORACLES["role_override"] = with_roles(f"""
SELECT warehouse, count(*) AS rows, {r('sum(stock)')} AS stock FROM inventory WHERE stock > 0 GROUP BY warehouse""")

# ---- streaming ----------------------------------------------------------
ORACLES["streaming_daily_demand"] = f"""
SELECT CAST(date_trunc('day', ts) AS DATE) AS date, CAST(user_id AS VARCHAR) AS sku,
       {r("sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE))")} AS qty, count(*) AS events
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""

# ---- workspace summary --------------------------------------------------
BENCH_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "region": ["r_regionkey", "r_name"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}


def _summary_sql() -> str:
    from replenish.functions.naming import infer_role, pick_tables
    picked = {v: k for k, v in pick_tables(BENCH_COLUMNS).items() if v}
    parts = []
    for t in sorted(BENCH_COLUMNS):
        parts.append(f"SELECT {sq(t)} AS \"table\", count(*) AS rows, CAST({len(BENCH_COLUMNS[t])} AS BIGINT) AS columns, "
                     f"{sq(infer_role(t, BENCH_COLUMNS[t]))} AS inferred_role, {sq(picked.get(t, ''))} AS detected_role FROM {t}")
    return " UNION ALL ".join(parts)


ORACLES["table_summary"] = _summary_sql()

ORACLES["demand_daily_series"] = with_roles(f"SELECT sku, date, {r('sum(qty)')} AS qty FROM sales GROUP BY sku, date")

ORACLES["cost_curves_penalty"] = with_model_ctes(CURVES.replace(f"unit_cost * {dbl(1.5)}", f"unit_cost * {dbl(3.0)}"), f"""
SELECT {r('service_level', 2)} AS service_level, {r('carrying_cost', 2)} AS carrying_cost, {r('stockout_cost', 2)} AS stockout_cost,
       {r('carrying_cost + stockout_cost', 2)} AS total_cost FROM cc""")

ORACLES["streaming_spike_watch"] = f"""
WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS date, CAST(user_id AS VARCHAR) AS sku,
                  sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS qty
           FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
f AS (SELECT sku, quantile_cont(qty, 0.75) + (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) * {dbl(1.5)} AS upper,
             avg(qty) + stddev_samp(qty) * 2 AS two_sigma
      FROM d GROUP BY sku HAVING count(*) >= 10)
SELECT d.date, d.sku, {r('d.qty')} AS qty, {r('f.upper')} AS upper,
       CASE WHEN d.qty < f.upper * {dbl(1.8)} THEN 'Medium' ELSE 'High' END AS severity
FROM d JOIN f ON d.sku = f.sku WHERE d.qty > greatest(f.upper, f.two_sigma)"""

# ---- listings ------------------------------------------------------------
_COVER = r("CASE WHEN isinf(days_of_cover) OR isnan(days_of_cover) THEN NULL ELSE days_of_cover END")
ORACLES["bom_parents"] = with_roles("SELECT DISTINCT parent_sku FROM bom WHERE parent_sku IS NOT NULL")
ORACLES["risk_listing"] = with_model(f"""
SELECT sku, product, warehouse, {r('stock')} AS stock, {r('incoming_qty')} AS incoming_qty, {_COVER} AS days_of_cover,
       {r('lead_time_days')} AS lead_time_days, {r('reorder_point')} AS reorder_point, {r('shortage_qty')} AS shortage_qty,
       stockout_risk, supplier_name FROM base""")
ORACLES["scenario_listing"] = with_model(f"""
SELECT sku, product, warehouse, {r('stock')} AS stock, {r('avg_daily_demand')} AS avg_daily_demand, {r('lead_time_days')} AS lead_time_days,
       {_COVER} AS days_of_cover, {r('reorder_point')} AS reorder_point, {r('recommended_order_qty')} AS recommended_order_qty,
       stockout_risk FROM base""")
ORACLES["supplier_names"] = with_model_ctes(SUPPLIER_RISK, "SELECT DISTINCT supplier_name FROM sr WHERE supplier_name IS NOT NULL")
ORACLES["sku_list"] = with_model("SELECT DISTINCT sku FROM base")
ORACLES["plan_suppliers"] = with_model("""
SELECT 'All suppliers' AS supplier_id
UNION ALL SELECT DISTINCT supplier_id FROM base WHERE recommended_order_qty > 0 AND supplier_id IS NOT NULL""")
ORACLES["freight_listing"] = with_model_ctes(FREIGHT, "SELECT sku, product, " + ", ".join(
    f"{r(n)} AS {n}" for n in ("annual_demand", "unit_cost", "lead_time_ocean", "lead_time_air", "total_cost_ocean", "total_cost_air",
                               "cost_difference")) + ", recommended_mode FROM fr2")
ORACLES["finance_listing"] = with_model_ctes(FIN, "SELECT sku, product, storage_class, " + ", ".join(
    f"{r(n)} AS {n}" for n in ("annual_cogs", "average_inventory_value", "itr", "dio", "annual_carrying_cost")) + " FROM fin")
ORACLES["stock_preview"] = with_model("""
SELECT sku, product, warehouse, isinf(days_of_cover) AS endless_cover, CAST(next_eta AS VARCHAR) AS next_eta
FROM base ORDER BY sku, product, warehouse LIMIT 500""")
