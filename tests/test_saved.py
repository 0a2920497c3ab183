"""Written tables with a manifest, saved scenarios, playbook rules."""
import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from replenish.operators.playbooks import DEFAULTS, compiled, playbook_table
from replenish.operators.scenarios import ScenarioStore
from replenish.sinks.export import read_tables, write_tables


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip_keeps_every_value(spark, tmpdir_path, fmt):
    rows = [(1, 'a "quoted", text', 1.5, True), (2, "", float("nan"), False), (3, None, math.inf, None), (4, "back\\slash; é", None, True)]
    one = spark.createDataFrame(rows, "id int, name string, v double, ok boolean")
    two = spark.createDataFrame([], "day date, n long")
    write_tables({"one": one, "two": two}, tmpdir_path, fmt)
    back = read_tables(spark, tmpdir_path)
    got = sorted(tuple(r) for r in back["one"].collect())
    assert got == [(i, n, None if v is None or math.isnan(v) or math.isinf(v) else v, ok) for i, n, v, ok in rows]
    assert back["two"].count() == 0 and back["two"].columns == ["day", "n"]


def test_a_missing_part_is_seen(spark, tmpdir_path):
    write_tables({"one": spark.range(100).repartition(4)}, tmpdir_path, "json")
    folder = os.path.join(tmpdir_path, "one")
    parts = [n for n in os.listdir(folder) if n.startswith("part")]
    os.replace(os.path.join(folder, parts[0]), os.path.join(folder, "_hidden"))
    with pytest.raises(ValueError, match="manifest says 100"):
        read_tables(spark, tmpdir_path)


def test_saved_scenarios(spark, tmpdir_path):
    store = ScenarioStore(spark, os.path.join(tmpdir_path, "scenarios"))
    rows = lambda *x: spark.createDataFrame(list(x), "name string, critical_skus long")
    read = lambda: sorted(tuple(r) for r in store.read().collect())
    assert store.read() is None
    store.save(rows(("a", 1), ("b", 2)))
    store.save(rows(("b", 3), ("c", 4)))
    assert read() == [("a", 1), ("b", 3), ("c", 4)]
    old = store.read()  # a reader of this version isn't disturbed by the next
    failing = rows(("a", 9)).withColumn("critical_skus", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.save(failing)
    assert read() == [("a", 1), ("b", 3), ("c", 4)]
    for i in range(11):
        store.save(rows(("d", i)))
    assert read()[-1] == ("d", 10) and sorted(tuple(r) for r in old.collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_rules_are_compiled_from_data(spark):
    values = {**DEFAULTS, "as_of": dt.date(2024, 1, 10)}
    df = spark.createDataFrame([(dt.date(2024, 1, 9), None), (dt.date(2024, 1, 10), 80.0), (None, None), (dt.date(2024, 2, 1), 75.0)],
                               "expected_date date, supplier_risk_score double")
    cond = compiled("expected_date < {as_of} OR coalesce(supplier_risk_score > {risk_limit}, false)", values)
    assert [r.x for r in df.select(F.coalesce(cond, F.lit(False)).alias("x")).collect()] == [True, True, False, False]
    rules = [("Budget guardrail", "budget", "order_value > {monthly_budget}"), ("Daily stockout watch", "positions", "stockout_risk = 'High'")]
    results = {"budget": spark.createDataFrame([(1.0,), (9.0,)], "order_value double"), "positions": spark.createDataFrame([("High",)], "stockout_risk string")}
    got = {r["name"]: r["flagged"] for r in playbook_table(results, rules, monthly_budget=5.0).collect()}
    assert len(got) == 5 and got["Budget guardrail"] == 1 and got["Daily stockout watch"] == 1 and got["Demand spike watch"] is None
