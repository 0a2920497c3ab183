"""The playbooks as rules. A rule is data - the playbook, the result table
it looks at, a condition over its columns with named thresholds - and is
compiled to a column expression. All rules of a table are counted in one
aggregation over it; one number per rule comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.operators.outputs import PLAYBOOKS, playbooks

#: (playbook, result table, condition)
RULES = (
    (PLAYBOOKS[0][0], "positions", "stockout_risk IN ('Critical', 'High')"),
    (PLAYBOOKS[1][0], "open_orders", "expected_date < {as_of} OR coalesce(supplier_risk_score > {risk_limit}, false)"),
    (PLAYBOOKS[2][0], "positions", "days_of_cover > {cover_days} OR avg_daily_demand < {least_demand}"),
    (PLAYBOOKS[3][0], "spikes", "metric = 'demand_spike'"),
    (PLAYBOOKS[4][0], "budget", "order_value > {monthly_budget}"),
)
DEFAULTS = {"risk_limit": 75.0, "cover_days": 90, "least_demand": 0.2}


def compiled(condition: str, values: dict):
    """A rule's condition as a column; thresholds become literals."""
    literal = lambda v: f"DATE'{v}'" if hasattr(v, "isoformat") else f"CAST({v!r} AS DOUBLE)"
    return F.expr(condition.format(**{k: literal(v) for k, v in values.items()}))


def playbook_table(results: dict[str, DataFrame], rules=RULES, **values) -> DataFrame:
    """The playbook table with the number of rows that each rule flags now (null for a playbook without a rule)."""
    values = {**DEFAULTS, **values}
    parts = None
    for table in dict.fromkeys(t for _, t, _ in rules):
        mine = [(name, cond) for name, t, cond in rules if t == table]
        counts = results[table].agg(*[F.count_if(F.coalesce(compiled(c, values), F.lit(False))).alias(f"n{i}") for i, (_, c) in enumerate(mine)])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("flagged")) for i, (name, _) in enumerate(mine)])).alias("r")).select("r.*")
        parts = rows if parts is None else parts.unionByName(rows)
    flagged = parts.groupBy("name").agg(F.sum("flagged").alias("flagged"))
    return playbooks(flagged.sparkSession).join(flagged, "name", "left")
