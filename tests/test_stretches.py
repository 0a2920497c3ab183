"""SKUs of many rows: the greedy in stretches, scans with a null segment, sessions without a checkpoint setting."""
import random

import pytest
from pyspark.sql import functions as F

from replenish.operators import transfers as X
from replenish.operators.scan import running
from tests.test_mended import nested_loop

POSITION = ("sku string, product string, warehouse string, unit_cost double, annual_revenue double, stock double, "
            "safety_stock double, reorder_point double")


def positions(rng, sku, n, amounts):
    rows = []
    for k in range(n):
        amount, deficit = amounts(), rng.random() < 0.5
        stock, safety, rop = (10.0, 10.0 + amount, 99.0) if deficit else (20.0 + amount, 5.0, 20.0)
        rows.append((sku, "p", f"w{k:05}", 2.0 + k % 3, float(rng.randrange(5)), stock, safety, rop))
    return rows


@pytest.mark.parametrize("stretch", [7, 50, 100_000])
def test_stretches_equal_the_nested_loop(spark, stretch):
    rng = random.Random(stretch)
    rows = positions(rng, "hot", 400, lambda: rng.random() * 12) + positions(rng, "ones", 120, lambda: 1.0 + rng.random() * 0.9)
    rows += positions(rng, "whole", 90, lambda: float(rng.randrange(4))) + positions(rng, "small", 5, lambda: 3.5)
    rows += [("shortage", "p", f"w{k}", 1.0, 1.0, 10.0, 30.0, 99.0) for k in range(60)] + [("shortage", "p", "x", 1.0, 0.0, 50.5, 5.0, 20.0)]
    got = X.exact_transfers(spark.createDataFrame(rows, POSITION).repartition(5), stretch=stretch).collect()
    want = []
    for sku in ("hot", "ones", "whole", "small", "shortage"):
        mine = sorted((r for r in rows if r[0] == sku), key=lambda r: (-r[4], r[1], r[2]))
        amounts = [(r[0], r[2], max(r[6] - r[5], 0.0), (r[5] - r[7]) if r[5] >= r[6] and r[5] > r[7] else 0.0, r[1], r[3]) for r in mine]
        want += nested_loop(amounts)
    assert sorted((m.sku, m.from_warehouse, m.to_warehouse, m.qty, m.saved_value) for m in got) == sorted(want)
    assert len(want) > 300


def test_a_hot_sku_runs_in_several_tasks(spark, monkeypatch):
    rng = random.Random(1)
    walk = X._walk_stretch
    rows = spark.createDataFrame(positions(rng, "hot", 300, lambda: rng.random() * 9), POSITION)
    monkeypatch.setattr(X, "_walk_stretch", lambda pdf: walk(pdf).assign(qty=len(pdf), unit_cost=pdf["lo"].max()))
    tasks = {(r.unit_cost, r.qty) for r in X.exact_transfers(rows, stretch=40).select("unit_cost", "qty").distinct().collect()}
    assert len(tasks) >= 5 and max(n for _, n in tasks) <= 40 + 12  # a stretch, and what the one before left open


def test_null_segment_over_several_partitions(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "a").alias("seg"))
    got = running(df, [F.col("id")], {"n": (F.lit(1), "sum"), "top": (F.col("id"), "max")}, segment=["seg"], partitions=8).collect()
    assert sorted((r.id, r.n, r.top) for r in got) == [(i, i // 2 + 1, i) for i in range(400)]


def test_draft_lines_without_a_supplier_are_ranked_once(spark):
    from replenish.operators.outputs import draft_lines

    plan = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "s1").alias("supplier_id"), F.concat(F.lit("k"), "id").alias("sku"), F.lit("p").alias("product"),
        F.lit("w").alias("warehouse"), F.lit(2.0).alias("recommended_order_qty"), F.lit("High").alias("stockout_risk"),
        (F.col("id") * 1.5).alias("recommended_order_value"), F.col("id").cast("double").alias("annual_revenue"))
    lines = draft_lines(plan.repartition(6)).collect()
    for supplier, n in ((None, 200), ("s1", 100)):
        assert sorted(r["rank"] for r in lines if r.supplier_id == supplier) == list(range(1, n + 1))


def test_checkpoint_folder_without_a_setting(spark, monkeypatch):
    """A local session whose configuration names no folder gets one, kept by the context."""
    from replenish import session

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError(f"{key} can't be changed in a running session")

    class Context:
        master, folder = "local[4]", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, d):
            self.folder = d

    class Session:
        conf, sparkContext = Conf(), Context()

    first = session.checkpoint_dir(Session)
    assert first and session.checkpoint_dir(Session) == first
    Session.sparkContext.folder, Session.sparkContext.master = None, "spark://somewhere:7077"
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session)
