"""Inter-warehouse transfers.

A planning row below its safety stock has a deficit (ss - stock); a row
above its reorder point has a surplus (stock - rop). Within a SKU, deficits
are served from surpluses greedily in planning order.

``whole_unit_transfers`` works on amounts floored to whole units. There the
greedy equals the overlap of the two running-sum lines (deficits laid end to
end against surpluses laid end to end). Overlapping pairs are found with a
sweep over the merged interval starts: at each start the active interval of
the other side is a running maximum, computed with the range-partitioned
two-pass scan, so a SKU of any size is spread over many tasks and no pair
set is ever enumerated.

``exact_transfers`` reproduces the original fractional greedy, whose "skip
when the remainder is below one unit" rule is sequential. Candidate rows
only (rows with a deficit or a surplus, of SKUs having both) are clustered
by sku, sorted in planning order and walked once per partition with
``mapInPandas``: a linear walk with two pointers. A SKU with more than
``STRETCH`` rows is walked in stretches: its rows are ordered by the
running sums of their sides (one range-partitioned scan), which brings
together what can meet, and cut into stretches of ``STRETCH`` rows. Each
stretch is a task of its own that starts from what the one before left open -
the two heads with their remainders, and the rows that the lost fractions
made the other side miss - so no task holds a SKU. The stretches of one SKU
follow each other (a lost fraction shifts all later meetings), those of
different SKUs run side by side."""

from __future__ import annotations

from collections import deque
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.operators.scan import running
from replenish.session import scratch_path

#: Rows of one SKU that one task walks.
STRETCH = 200_000

TRANSFER_SCHEMA = ("sku string, product string, from_warehouse string, to_warehouse string, "
                   "qty long, unit_cost double, saved_value double")


def _sides(base: DataFrame) -> DataFrame:
    """X1 + X2: deficit / surplus per row of SKUs stocked in > 1 row, when
    more than one warehouse exists overall."""
    c = F.col
    n_wh = base.select(F.count_distinct("warehouse")).scalar()
    deficit = F.when(c("stock") < c("safety_stock"), c("safety_stock") - c("stock")).otherwise(F.lit(0.0))
    surplus = F.when((c("stock") >= c("safety_stock")) & (c("stock") > c("reorder_point")),
                     c("stock") - c("reorder_point")).otherwise(F.lit(0.0))
    rows = base.select("sku", "product", "warehouse", "unit_cost", "annual_revenue",
                       deficit.alias("deficit"), surplus.alias("surplus"))
    # SKUs having both sides (a combinable aggregation, then a semi join)
    both = rows.groupBy("sku").agg(F.max("deficit").alias("md"), F.max("surplus").alias("ms"),
                                   F.count(F.lit(1)).alias("n"))
    both = both.where((F.col("n") >= 2) & (F.col("md") > 0) & (F.col("ms") > 0)).select("sku")
    return rows.where(n_wh > 1).join(both, "sku", "left_semi")


def whole_unit_transfers(base: DataFrame, partitions: int | None = None) -> DataFrame:
    c = F.col
    rows = _sides(base).withColumn("d", F.floor("deficit")).withColumn("s", F.floor("surplus"))
    order = [c("annual_revenue").desc(), c("product"), c("warehouse")]
    # running line positions per SKU and side in one scan (segment = sku, side)
    sides = (rows.where(c("d") >= 1).select("sku", "product", "warehouse", "unit_cost", "annual_revenue",
                                            F.lit(1).alias("side"), c("d").alias("amt"))
             .unionByName(rows.where(c("s") >= 1).select("sku", "product", "warehouse", "unit_cost", "annual_revenue",
                                                         F.lit(0).alias("side"), c("s").alias("amt"))))
    pos = running(sides, order, {"hi": (c("amt"), "sum")}, segment=["sku", "side"], partitions=partitions)
    ev = pos.select("sku", (c("hi") - c("amt")).alias("lo"), "hi", "side",
                    F.struct((c("hi") - c("amt")).alias("lo"), c("hi").alias("hi"), "warehouse", "product",
                             "unit_cost").alias("iv"))
    # surplus starts sort before deficit starts at the same position
    ev_order = [c("lo"), c("side"), c("iv.warehouse"), c("iv.product")]
    swept = running(ev, ev_order, {
        "act_d": (F.when(c("side") == 1, c("iv")), "max"),
        "act_s": (F.when(c("side") == 0, c("iv")), "max"),
    }, segment=["sku"], partitions=partitions)
    is_d = c("side") == 1
    dd = F.when(is_d, c("iv")).otherwise(c("act_d"))
    ss = F.when(is_d, c("act_s")).otherwise(c("iv"))
    pairs = swept.select("sku", dd.alias("D"), ss.alias("S")).where(c("D").isNotNull() & c("S").isNotNull())
    qty = F.least(c("D.hi"), c("S.hi")) - F.greatest(c("D.lo"), c("S.lo"))
    pairs = pairs.withColumn("q", qty).where(c("q") >= 1)
    return pairs.select(
        "sku", c("D.product").alias("product"), c("S.warehouse").alias("from_warehouse"),
        c("D.warehouse").alias("to_warehouse"), c("q").cast("long").alias("qty"),
        c("D.unit_cost").alias("unit_cost"), (c("q") * c("D.unit_cost")).alias("saved_value"))


_OUT_COLS = ["sku", "product", "from_warehouse", "to_warehouse", "qty", "unit_cost", "saved_value"]


def _walk(rows):
    """Rows (sku, warehouse, deficit, surplus, product, unit_cost), clustered
    by sku and in planning order, to transfers.

    An amount below one unit can never move again, so only the first open
    deficit and the first open surplus matter: each meets the other until
    one of them falls below a unit and makes room for the next. Linear in
    the rows; what waits is the side that has nothing to meet yet."""
    current, deficits, surpluses = None, deque(), deque()
    for sku, warehouse, deficit, surplus, product, unit_cost in rows:
        if sku != current:
            current = sku
            deficits.clear()
            surpluses.clear()
        if deficit >= 1:
            deficits.append([deficit, warehouse, product, unit_cost])
        if surplus >= 1:
            surpluses.append([surplus, warehouse])
        while deficits and surpluses:
            need, give = deficits[0], surpluses[0]
            q = min(need[0], give[0])
            yield sku, need[2], give[1], need[1], int(round(q)), float(need[3]), float(q * need[3])
            need[0] -= q
            give[0] -= q
            if need[0] < 1:
                deficits.popleft()
            if give[0] < 1:
                surpluses.popleft()


def _walk_partitions(batches):
    """One walk over all Arrow batches of a partition."""
    def rows():
        for pdf in batches:
            yield from zip(pdf["sku"], pdf["warehouse"], pdf["deficit"], pdf["surplus"], pdf["product"], pdf["unit_cost"])

    moves = _walk(rows())
    while out := list(islice(moves, 10_000)):
        yield pd.DataFrame(out, columns=_OUT_COLS)


def _walk_stretch(pdf: pd.DataFrame) -> pd.DataFrame:
    """One stretch of one SKU with what the stretches before left open: rows
    (sku, side, lo, amt, ...) to moves, and the rows left open with what
    remains of them (``to_warehouse`` null)."""
    pdf = pdf.sort_values("lo", kind="stable")
    left = {side: pdf[pdf["side"] == side].to_dict("records") for side in (1, 0)}
    open_, moves = {1: 0, 0: 0}, []
    needs, gives = left[1], left[0]
    while open_[1] < len(needs) and open_[0] < len(gives):
        need, give = needs[open_[1]], gives[open_[0]]
        q = min(need["amt"], give["amt"])
        moves.append({**need, "from_warehouse": give["warehouse"], "to_warehouse": need["warehouse"], "qty": int(round(q)),
                      "saved_value": float(q * need["unit_cost"])})
        need["amt"] -= q
        give["amt"] -= q
        open_[1] += need["amt"] < 1
        open_[0] += give["amt"] < 1
    rest = [{**r, "from_warehouse": None, "to_warehouse": None, "qty": 0, "saved_value": 0.0}
            for side in (1, 0) for r in left[side][open_[side]:]]
    return pd.DataFrame(moves + rest, columns=[*_STRETCH_COLS, "from_warehouse", "to_warehouse", "qty", "saved_value"])


_STRETCH_COLS = ["sku", "side", "lo", "amt", "product", "warehouse", "unit_cost", "last"]


def _stretched_transfers(cand: DataFrame, stretch: int) -> DataFrame:
    """The greedy for SKUs of many rows, stretch by stretch. Every step is
    written, so a lost executor costs one stretch."""
    c, spark = F.col, cand.sparkSession
    need = c("deficit") >= 1
    sides = cand.where(need | (c("surplus") >= 1)).select(
        "sku", "product", "warehouse", "unit_cost", "annual_revenue", need.cast("int").alias("side"),
        F.when(need, c("deficit")).otherwise(c("surplus")).alias("amt"))
    order = [c("annual_revenue").desc(), c("product"), c("warehouse")]
    placed = running(sides, order, {"hi": (c("amt"), "sum")}, segment=["sku", "side"]).withColumn("lo", c("hi") - c("amt"))
    met = running(placed, [c("lo"), c("side")], {"n": (F.lit(1).cast("long"), "sum")}, segment=["sku"])
    folder = scratch_path(spark, "stretches")
    cut = met.select("sku", "side", "lo", "amt", "product", "warehouse", "unit_cost", F.floor((c("n") - 1) / stretch).alias("stretch"))
    cut.write.partitionBy("stretch").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    lasts = rows.groupBy("sku").agg(F.max("stretch").cast("long").alias("last"))
    rows = rows.join(lasts, "sku").select(*_STRETCH_COLS, "stretch")
    kinds = cand.schema
    schema = ", ".join([f"sku string, side int, lo double, amt double, product {kinds['product'].dataType.simpleString()}",
                        f"warehouse {kinds['warehouse'].dataType.simpleString()}, unit_cost double, last long",
                        "from_warehouse string, to_warehouse string, qty long, saved_value double"])
    carried = None
    for step in range((lasts.agg(F.max("last")).first()[0] or 0) + 1):
        now = rows.where(c("stretch") == step).drop("stretch")
        if carried is not None:
            now = now.unionByName(carried)
        (now.groupBy("sku").applyInPandas(_walk_stretch, schema)
         .write.parquet(f"{folder}/walked/step={step}"))
        walked = spark.read.schema(schema).parquet(f"{folder}/walked/step={step}")
        carried = walked.where(c("to_warehouse").isNull() & (c("last") > step)).select(*_STRETCH_COLS)
    return spark.read.schema(schema).parquet(f"{folder}/walked").where(c("to_warehouse").isNotNull()).select(*_OUT_COLS)


def exact_transfers(base: DataFrame, stretch: int = STRETCH) -> DataFrame:
    cand = _sides(base).where((F.col("deficit") > 0) | (F.col("surplus") > 0))
    # SKUs of many rows: at most one for every ``stretch`` rows of the table
    large = base.groupBy("sku").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > stretch).select("sku")
    some = not large.isEmpty()
    plain = cand.join(large, "sku", "left_anti") if some else cand
    ordered = (plain.repartition("sku")
               .sortWithinPartitions("sku", F.col("annual_revenue").desc(), "product", "warehouse")
               .select("sku", "warehouse", "deficit", "surplus", "product", "unit_cost"))
    moves = ordered.mapInPandas(_walk_partitions, TRANSFER_SCHEMA)
    if not some:
        return moves
    return moves.unionByName(_stretched_transfers(cand.join(large, "sku", "left_semi"), stretch))


def transfer_summary(transfers: DataFrame) -> DataFrame:
    """Total saved value and count."""
    return transfers.agg(F.coalesce(F.sum("saved_value"), F.lit(0.0)).alias("saved_transfer_value"),
                         F.count(F.lit(1)).alias("transfers_count"))


def top_transfers(transfers: DataFrame, n: int = 15) -> DataFrame:
    """The n transfers with the highest saved value."""
    return transfers.orderBy(F.col("saved_value").desc(), "sku", "from_warehouse", "to_warehouse").limit(n)
