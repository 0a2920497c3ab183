"""Seeded random property tests."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from replenish.operators.scan import running
from replenish.operators.transfers import exact_transfers, whole_unit_transfers


def greedy_loop(defs, surs):
    """The original nested-loop greedy, written out for the test."""
    defs = [list(d) for d in defs]
    surs = [list(s) for s in surs]
    out = []
    for d in defs:
        for s in surs:
            if d[1] <= 0 or s[1] <= 0:
                continue
            q = min(d[1], s[1])
            if q >= 1:
                out.append((s[0], d[0], q))
                d[1] -= q
                s[1] -= q
    return out


@pytest.mark.parametrize("seed", range(5))
def test_running_sum_matches_global_window(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c", None][:3]), float(rnd.randint(0, 5))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = running(df, [F.col("v").desc(), F.col("id")], {"c": (F.col("v"), "sum"), "mx": (F.col("id"), "max")}, partitions=7)
    w = Window.orderBy(F.col("v").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.sum("v").over(w).alias("rc"), F.max("id").over(w).alias("rm"))
    bad = got.join(ref, "id").where((F.col("c") != F.col("rc")) | (F.col("mx") != F.col("rm"))).count()
    assert bad == 0 and got.count() == 500
    seg = running(df, [F.col("id")], {"c": (F.col("v"), "sum")}, segment=["g"], partitions=5)
    w2 = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref2 = df.select("id", F.sum("v").over(w2).alias("rc"))
    assert seg.join(ref2, "id").where(F.col("c") != F.col("rc")).count() == 0


def _base_rows(rnd, n_sku, integral):
    rows = []
    for s in range(n_sku):
        for w in range(rnd.randint(2, 6)):
            stock = float(rnd.randint(0, 60))
            ss = rnd.randint(0, 30) + (0 if integral else rnd.random())
            rop = ss + rnd.randint(0, 20) + (0 if integral else rnd.random())
            rows.append((f"S{s}", "p", f"W{w}", stock, float(ss), float(rop), 2.0, float(rnd.randint(0, 3))))
    return rows


SCHEMA = ("sku string, product string, warehouse string, stock double, safety_stock double, reorder_point double, "
          "unit_cost double, annual_revenue double")


def _expected(rows):
    out = []
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for sku, g in pdf.groupby("sku"):
        g = g.sort_values(["annual_revenue", "product", "warehouse"], ascending=[False, True, True])
        defs = [(r.warehouse, r.safety_stock - r.stock) for r in g.itertuples() if r.stock < r.safety_stock]
        surs = [(r.warehouse, r.stock - r.reorder_point) for r in g.itertuples()
                if r.stock >= r.safety_stock and r.stock > r.reorder_point]
        out += [(sku, f, t, q) for f, t, q in greedy_loop(defs, surs)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact_transfers_equal_loop(spark, seed):
    rnd = random.Random(100 + seed)
    rows = _base_rows(rnd, 25, integral=False)
    got = sorted((r["sku"], r["from_warehouse"], r["to_warehouse"], round(r["saved_value"] / 2.0, 9))
                 for r in exact_transfers(spark.createDataFrame(rows, SCHEMA)).collect())
    exp = sorted((s, f, t, round(q, 9)) for s, f, t, q in _expected(rows))
    assert got == exp


@pytest.mark.parametrize("seed", range(3))
def test_whole_unit_overlap_equals_greedy(spark, seed):
    rnd = random.Random(200 + seed)
    rows = _base_rows(rnd, 30, integral=True)
    got = sorted((r["sku"], r["from_warehouse"], r["to_warehouse"], float(r["qty"]))
                 for r in whole_unit_transfers(spark.createDataFrame(rows, SCHEMA), partitions=6).collect())
    exp = sorted((s, f, t, float(q)) for s, f, t, q in _expected(rows))
    assert got == exp
    tot = sum(g[3] for g in got)
    dsum = sum(max(r[4] - r[3], 0) for r in rows)
    assert tot <= dsum


def test_abc_share_monotone_and_ends_at_one(spark):
    from replenish.operators.reorder import abc_classes
    rnd = random.Random(7)
    rows = [(f"s{i}", "p", "w", float(rnd.choice([0, 0, 1, 5, 10, 100]))) for i in range(300)]
    df = spark.createDataFrame(rows, "sku string, product string, warehouse string, annual_revenue double")
    out = abc_classes(df, partitions=6).orderBy(F.col("annual_revenue").desc(), "sku").collect()
    shares = [r["cum_revenue_pct"] for r in out]
    assert all(a <= b + 1e-12 for a, b in zip(shares, shares[1:]))
    assert shares[-1] == pytest.approx(1.0)
    assert {r["abc_class"] for r in out} <= {"A", "B", "C"}


def test_top_k_per_group_equals_plain_window(spark):
    from replenish.operators.outputs import ranked, top_k_per_group
    rnd = random.Random(11)
    # one hot group holding most rows
    rows = [(("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 9)}"), i, float(rnd.randint(0, 1000)))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    order = [F.col("v").desc(), F.col("id")]
    got = {(r["g"], r["rank"], r["id"]) for r in top_k_per_group(df, ["g"], order, 7).collect()}
    w = Window.partitionBy("g").orderBy(*order)
    exp = {(r["g"], r["rank"], r["id"]) for r in
           df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 7).collect()}
    assert got == exp
    capped = [(r["rank"], r["id"]) for r in ranked(df, order, 5).orderBy("rank").collect()]
    full = [(r["rank"], r["id"]) for r in ranked(df, order, None).orderBy("rank").limit(5).collect()]
    assert capped == full and [x[0] for x in capped] == [1, 2, 3, 4, 5]
