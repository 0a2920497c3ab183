"""KPI row, alert queue, playbooks and text documents.

Text follows the original templates; the product signature lines are
replaced by neutral wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replenish.functions import planning as P
from replenish.functions.text import fmt_fixed, fmt_grouped, fmt_int, fmt_int_grouped, py_float_str
from replenish.operators.reorder import TIE, plan_order, revenue_order
from replenish.operators.scan import running

# Alert action texts.
ACTION_SUPPLIER = "Review alternate suppliers, open PO ETAs, and quality issues before new large orders."
ACTION_DEAD = "Consider markdown, bundle, ad campaign, or stop replenishment."
ACTION_TRANSFER = "Review the Inter-DC Transfer Advisor tab to approve internal inventory routing."

# Automation playbooks (name, trigger, condition, action, approval).
PLAYBOOKS = (
    ("Daily stockout watch", "Every day 08:30", "stockout_risk in Critical or High",
     "Create reorder task + send procurement draft for approval", True),
    ("Supplier delay watch", "Every 4 hours", "open PO expected date breached or supplier risk > 75",
     "Notify operations owner and request ETA update", False),
    ("Dead-stock cleanup", "Weekly Monday", "days_of_cover > 90 or avg_daily_demand < 0.2",
     "Create markdown/bundling candidate list", True),
    ("Demand spike watch", "Daily after sales sync", "IQR demand anomaly detected",
     "Check promo/calendar cause and recalculate reorder plan", False),
    ("Budget guardrail", "Before PO approval", "recommended_order_value exceeds monthly budget threshold",
     "Route to finance approval", True),
)

# Document templates.
DRAFT_EMPTY = ("Subject: Reorder Review\n\nHi team,\n\nNo reorder items are currently flagged for this supplier."
               "\n\nRegards,\nOperations")
DRAFT_HEAD = ["Subject: Reorder Approval Request", "", "Hi team,", "",
              "Please review the following reorder recommendations before purchase approval:", ""]
DRAFT_TAIL_NOTE = "Please confirm budget, supplier ETA, and any open purchase orders before releasing this order."
DRAFT_SIGN = ["", "Regards,", "Operations"]
RFQ_INTRO = "We would like to request a formal quotation for the purchase of the following items:"
RFQ_ASK = ("Please confirm your capacity to supply this quantity, your standard lead time, payment terms, "
           "and total pricing including shipping terms (FOB/DDP).")
RFQ_SIGN = ["", "We look forward to your prompt response.", "", "Best regards,", "Procurement Team"]
REPORT_TITLE = "# Supply Chain Executive Report"
GOVERNANCE = ["- Treat recommendations as decision support, not automatic purchase approval.",
              "- Review supplier contracts, cash limits, lead-time assumptions, and current open POs before placing orders.",
              "- Use approval gates for procurement emails, PO creation, and budget-impacting changes."]


def playbooks(spark) -> DataFrame:
    """The playbook table (constant)."""
    return spark.createDataFrame(list(PLAYBOOKS), "name string, trigger string, condition string, action string, "
                                                  "approval_required boolean")


def kpis(base: DataFrame, risk: DataFrame, returns: DataFrame, transfers: DataFrame, fin: DataFrame,
         horizon_days: int, service_level: float) -> DataFrame:
    """A1: one row; each source contributes through a scalar subquery."""
    c = F.col
    row = base.agg(
        F.coalesce(F.sum("inventory_value"), F.lit(0.0)).alias("total_inventory_value"),
        F.coalesce(F.sum(F.when(c("recommended_order_qty") > 0, c("recommended_order_value"))), F.lit(0.0)).alias("recommended_order_value"),
        F.count(F.when(c("stockout_risk") == P.RISK_CRITICAL, 1)).alias("critical_skus"),
        F.count(F.when(c("stockout_risk").isin(P.RISK_CRITICAL, P.RISK_HIGH), 1)).alias("high_risk_skus"),
        F.count(F.when(c("dead_stock_flag"), 1)).alias("dead_stock_skus"),
        F.count(F.when(c("overstock_flag"), 1)).alias("overstock_skus"),
    )
    sup_high = risk.select(F.count(F.when(c("risk_level").isin("Critical", "High"), 1))).scalar()
    ret = returns.select(F.struct(F.coalesce(F.sum("refund_amount"), F.lit(0.0)).alias("refund"),
                                  F.coalesce(F.sum("return_qty"), F.lit(0.0)).cast("long").alias("qty"))).scalar()
    tr = transfers.select(F.struct(F.coalesce(F.sum("saved_value"), F.lit(0.0)).alias("saved"),
                                   F.count(F.lit(1)).alias("n"))).scalar()
    fn = fin.select(F.struct(F.coalesce(F.sum("annual_cogs"), F.lit(0.0)).alias("cogs"),
                             F.coalesce(F.sum("average_inventory_value"), F.lit(0.0)).alias("avgv"),
                             F.coalesce(F.sum("annual_carrying_cost"), F.lit(0.0)).alias("carry"))).scalar()
    refund, ret_qty = ret.getField("refund"), ret.getField("qty")
    saved, n_tr = tr.getField("saved"), tr.getField("n")
    cogs, avgv, carry = fn.getField("cogs"), fn.getField("avgv"), fn.getField("carry")
    return row.select(
        "*",
        sup_high.alias("supplier_high_risk"),
        F.lit(int(horizon_days)).cast("long").alias("forecast_horizon_days"),
        F.lit(float(service_level)).alias("service_level"),
        refund.alias("total_refund_value"), ret_qty.alias("total_returns_qty"),
        saved.alias("saved_transfer_value"), n_tr.alias("transfers_count"),
        cogs.alias("total_annual_cogs"), avgv.alias("total_avg_inventory_value"),
        F.when(avgv > 0, cogs / avgv).otherwise(F.lit(0.0)).alias("portfolio_itr"),
        F.when(cogs > 0, F.lit(365.0) * avgv / cogs).otherwise(F.lit(365.0)).alias("portfolio_dio"),
        carry.alias("total_annual_carrying_cost"),
    )


def ranked(df: DataFrame, order: list[Column], cap: int | None, name: str = "rank") -> DataFrame:
    """First ``cap`` rows in ``order`` with their 1-based rank.

    A cap uses a top-k (per-task partial top-k, then a final merge of at most
    cap x tasks rows); without a cap the rank is a running count from the
    range-partitioned scan, never a single-task window."""
    if cap is not None:
        top = df.orderBy(*order).limit(cap)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return running(df, order, {name: (F.lit(1).cast("long"), "sum")})


def alerts(base: DataFrame, risk: DataFrame, transfers: DataFrame, caps=(None, None, None)) -> DataFrame:
    """A2-A5 as one queue: (alert_group, rank) gives the original order. ``caps`` keeps the first rows of the stock-out,
    supplier and dead-stock groups (``P.ALERT_CAPS`` gives the original's short queue)."""
    c = F.col
    # a full rank writes its rows once: only what order and message need
    order_cols = ["annual_revenue", *TIE]
    short = base.where(c("stockout_risk").isin(P.RISK_CRITICAL, P.RISK_HIGH)).select(
        *order_cols, "stockout_risk", "days_of_cover", "recommended_order_qty", "supplier_name", "supplier_id")
    so = ranked(short, revenue_order(), caps[0])
    so = so.select(
        F.lit(1).alias("alert_group"), "rank", F.lit("stockout_risk").alias("type"),
        F.when(c("stockout_risk") == P.RISK_CRITICAL, "P1").otherwise("P2").alias("priority"),
        "sku", F.lit(None).cast("string").alias("supplier_id"),
        F.concat(c("product"), F.lit(" has "), c("stockout_risk"), F.lit(" stockout risk with "),
                 fmt_fixed(c("days_of_cover"), 1), F.lit(" days of cover.")).alias("message"),
        F.concat(F.lit("Order "), fmt_int(c("recommended_order_qty")), F.lit(" units from "),
                 F.coalesce(c("supplier_name"), c("supplier_id")), F.lit(".")).alias("recommended_action"))
    sp = ranked(risk.where(c("risk_level").isin("High", "Critical")).select(
        "supplier_id", "supplier_name", "supplier_risk_score", "risk_level"),
                [c("supplier_risk_score").desc(), c("supplier_id")], caps[1])
    sp = sp.select(
        F.lit(2).alias("alert_group"), "rank", F.lit("supplier_risk").alias("type"),
        F.when(c("risk_level") == "Critical", "P1").otherwise("P2").alias("priority"),
        F.lit(None).cast("string").alias("sku"), "supplier_id",
        F.concat(F.lit("Supplier "), F.coalesce(c("supplier_name"), c("supplier_id")), F.lit(" has "),
                 c("risk_level"), F.lit(" risk score "), py_float_str(c("supplier_risk_score")), F.lit(".")).alias("message"),
        F.lit(ACTION_SUPPLIER).alias("recommended_action"))
    ds = ranked(base.where(c("dead_stock_flag")).select(*order_cols), revenue_order(), caps[2])
    ds = ds.select(
        F.lit(3).alias("alert_group"), "rank", F.lit("dead_stock").alias("type"), F.lit("P3").alias("priority"),
        "sku", F.lit(None).cast("string").alias("supplier_id"),
        F.concat(c("product"), F.lit(" has stock but almost no recent demand.")).alias("message"),
        F.lit(ACTION_DEAD).alias("recommended_action"))
    tr = transfers.agg(F.count(F.lit(1)).alias("n"), F.sum("saved_value").alias("v")).where(c("n") > 0)
    tr = tr.select(
        F.lit(4).alias("alert_group"), F.lit(1).cast("long").alias("rank"), F.lit("warehouse_transfer").alias("type"),
        F.lit("P3").alias("priority"), F.lit("Multiple").alias("sku"), F.lit(None).cast("string").alias("supplier_id"),
        F.concat(F.lit("Found "), c("n").cast("string"),
                 F.lit(" internal stock transfer opportunities to reduce purchasing cost by "),
                 fmt_grouped(c("v"), 2), F.lit(".")).alias("message"),
        F.lit(ACTION_TRANSFER).alias("recommended_action"))
    return so.unionByName(sp).unionByName(ds).unionByName(tr)


def _plan_line(c=F.col) -> Column:
    return F.concat(F.lit("- "), c("sku"), F.lit(" / "), c("product"), F.lit(": "), fmt_int(c("recommended_order_qty")),
                    F.lit(" units, risk "), c("stockout_risk"), F.lit(", estimated value "),
                    fmt_grouped(c("recommended_order_value"), 2))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group in ``order``. Spark keeps k rows per group and
    task below the shuffle (a rank limit), so a hot group is k x tasks rows."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def draft_lines(plan: DataFrame) -> DataFrame:
    """G1, all lines: (supplier_id, rank, line) for every plan row, ranked in
    plan order within its supplier by the range-partitioned scan."""
    c = F.col
    lines = plan.select("supplier_id", _plan_line().alias("line"), "stockout_risk", "recommended_order_value", "annual_revenue",
                        "sku", "product", "warehouse")
    ranks = running(lines, plan_order(), {"rank": (F.lit(1).cast("long"), "sum")}, segment=["supplier_id"])
    return ranks.select("supplier_id", c("rank").cast("long").alias("rank"), "line")


def procurement_drafts(plan: DataFrame, max_lines: int = 20) -> DataFrame:
    """G1: one approval draft per supplier of the plan, plus 'All suppliers'.

    Lines are the first ``max_lines`` plan rows in plan order (the letter's
    top-N; ``draft_lines`` has all); the total covers all of the supplier's
    plan rows."""
    c = F.col
    lines = plan.select("supplier_id", _plan_line().alias("line"), "stockout_risk", "recommended_order_value", "annual_revenue",
                        "sku", "product", "warehouse")
    per = top_k_per_group(lines, ["supplier_id"], plan_order(), max_lines)
    glob = ranked(lines, plan_order(), max_lines).withColumn("supplier_id", F.lit("All suppliers"))
    top = per.select("supplier_id", "rank", "line").unionByName(glob.select("supplier_id", "rank", "line"))
    body = top.groupBy("supplier_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("body"))
    tot = plan.groupBy("supplier_id").agg(F.sum("recommended_order_value").alias("total"))
    tot = tot.unionByName(plan.agg(F.sum("recommended_order_value").alias("total")).select(
        F.lit("All suppliers").alias("supplier_id"), "total"))
    j = body.join(tot, "supplier_id")
    text = F.concat_ws("\n", *[F.lit(x) for x in DRAFT_HEAD], c("body"), F.lit(""),
                       F.concat(F.lit("Estimated order value: "), fmt_grouped(c("total"), 2)), F.lit(""),
                       F.lit(DRAFT_TAIL_NOTE), *[F.lit(x) for x in DRAFT_SIGN])
    drafts = j.select("supplier_id", text.alias("draft"))
    # an empty plan still yields the 'All suppliers' draft, in its empty form
    empty = plan.sparkSession.createDataFrame([("All suppliers", DRAFT_EMPTY)], "supplier_id string, draft string")
    n = plan.select(F.count(F.lit(1))).scalar()
    return drafts.unionByName(empty.where(n == 0))


def rfq_drafts(first_rows: DataFrame, delivery_date: Column) -> DataFrame:
    """One RFQ per SKU addressed to the SKU's supplier; quantity = the
    recommended quantity or 100, price = unit cost."""
    c = F.col
    qty = F.when(c("recommended_order_qty") > 0, c("recommended_order_qty").cast("long")).otherwise(F.lit(100).cast("long"))
    price = F.when(c("unit_cost") > 0, F.concat(F.lit("- Target Unit Price: $"), fmt_grouped(c("unit_cost"), 2))
                   ).otherwise(F.lit("- Target Unit Price: Competitive Market Rate"))
    supplier = F.coalesce(c("supplier_name"), c("supplier_id"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Subject: Request for Quote (RFQ) - "), c("product"), F.lit(" ("), c("sku"), F.lit(")")),
        F.lit(""), F.concat(F.lit("Dear "), supplier, F.lit(" Team,")), F.lit(""), F.lit(RFQ_INTRO), F.lit(""),
        F.concat(F.lit("- Product Name: "), c("product")), F.concat(F.lit("- SKU: "), c("sku")),
        F.concat(F.lit("- Order Quantity: "), fmt_int_grouped(qty), F.lit(" units")), price,
        F.concat(F.lit("- Requested Delivery Date: "), F.date_format(delivery_date, "yyyy-MM-dd")),
        F.lit(""), F.lit(RFQ_ASK), *[F.lit(x) for x in RFQ_SIGN])
    return first_rows.select("sku", supplier.alias("supplier_name"), qty.alias("qty"), text.alias("rfq"))


def report_lines(kpi: DataFrame, plan: DataFrame, risk: DataFrame, alert_q: DataFrame, narrative: str = "",
                 top_orders: int = 10, top_suppliers: int = 8, top_alerts: int = 15) -> DataFrame:
    """The executive report as (section, item, text) rows, with the first
    ``top_*`` rows of the plan, the watch list and the alert queue."""
    c = F.col
    spark = kpi.sparkSession
    k = kpi.select(
        F.array(
            F.concat(F.lit("- Inventory value under review: **"), fmt_grouped(c("total_inventory_value"), 2), F.lit("**.")),
            F.concat(F.lit("- Recommended reorder value: **"), fmt_grouped(c("recommended_order_value"), 2), F.lit("**.")),
            F.concat(F.lit("- Critical SKUs: **"), c("critical_skus").cast("string"), F.lit("**.")),
            F.concat(F.lit("- High/Critical stockout SKUs: **"), c("high_risk_skus").cast("string"), F.lit("**.")),
            F.concat(F.lit("- Dead-stock candidates: **"), c("dead_stock_skus").cast("string"), F.lit("**.")),
            F.concat(F.lit("- High-risk suppliers: **"), c("supplier_high_risk").cast("string"), F.lit("**.")),
        ).alias("a"))
    summary = k.select(F.posexplode("a").alias("pos", "text")).select(
        F.lit(1).alias("section"), (c("pos") + 1).cast("long").alias("item"), "text")

    def const(section: int, texts: list[str]) -> DataFrame:
        return spark.createDataFrame([(section, i + 1, t) for i, t in enumerate(texts)],
                                     "section int, item long, text string")

    parts = [const(0, [REPORT_TITLE, "", "## Executive Summary"]), summary, const(2, [""])]
    if narrative:
        parts.append(const(3, ["## AI Operations Narrative", narrative.strip(), ""]))
    parts.append(const(4, ["## Top Reorder Recommendations"]))
    top = ranked(plan, plan_order(), top_orders).select(
        F.lit(5).alias("section"), c("rank").alias("item"),
        F.concat(F.lit("- **"), c("sku"), F.lit(" / "), c("product"), F.lit("**: order **"),
                 fmt_int(c("recommended_order_qty")), F.lit("** units; risk: **"), c("stockout_risk"),
                 F.lit("**; estimated value: **"), fmt_grouped(c("recommended_order_value"), 2), F.lit("**.")).alias("text"))
    parts.append(_or_else(top, 5, "No reorder recommendations were generated."))
    parts.append(const(6, ["", "## Supplier Risk Watchlist"]))
    sup = ranked(risk, [c("supplier_risk_score").desc(), c("supplier_id")], top_suppliers).select(
        F.lit(7).alias("section"), c("rank").alias("item"),
        F.concat(F.lit("- **"), F.coalesce(c("supplier_name"), c("supplier_id")), F.lit("**: risk score **"),
                 py_float_str(c("supplier_risk_score")), F.lit("** ("), F.coalesce(c("risk_level"), F.lit("nan")),
                 F.lit("); high-risk SKUs: **"), c("high_risk_skus").cast("string"), F.lit("**.")).alias("text"))
    parts.append(_or_else(sup, 7, "No supplier risk data available."))
    parts.append(const(8, ["", "## Recommended Operating Actions"]))
    al = ranked(alert_q, [c("alert_group"), c("rank")], top_alerts, "pos").select(
        F.lit(9).alias("section"), c("pos").alias("item"),
        F.concat(F.lit("- **"), c("priority"), F.lit(" / "), c("type"), F.lit("**: "), c("message"),
                 F.lit(" Action: "), c("recommended_action")).alias("text"))
    parts.append(al)
    parts.append(const(10, ["", "## Governance Notes", *GOVERNANCE]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(c("section").cast("int"), c("item").cast("long"), "text"))
    return out


def _or_else(df: DataFrame, section: int, text: str) -> DataFrame:
    """``df`` or, when it is empty, one fallback line (decided per query)."""
    spark = df.sparkSession
    fallback = spark.createDataFrame([(section, 1, text)], "section int, item long, text string")
    n = df.select(F.count(F.lit(1))).scalar()
    return df.unionByName(fallback.where(n == 0))
