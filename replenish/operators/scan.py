"""Ordered scans (running sums / running maxima) without a single-task window.

``Window.orderBy`` with no partition moves every row into one task. Here the
rows are range-partitioned on the sort key (Spark samples the key to pick
balanced bounds, ties included), each partition scans locally, and the
per-partition totals -- one row per partition and segment boundary, a size
bounded by the partition count -- are folded into offsets and joined back
with a broadcast. With ``segment`` columns the scan restarts per segment; a
segment larger than a partition simply spans several partitions. The
range-partitioned rows are checkpointed once (see ``running``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replenish.session import checkpoint_dir

_PID = "_scan_pid"


def _num_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: Sequence[Column], values: dict[str, tuple[Column, str]],
            segment: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Append running aggregates in ``order`` (within ``segment``).

    ``values`` maps output name -> (value column, 'sum' | 'max'); the frame
    is inclusive (rows up to and including the current one)."""
    n = _num_parts(df, partitions)
    seg = [F.col(s) for s in segment]
    keyed = df
    for name, (c, _) in values.items():
        keyed = keyed.withColumn(f"_v_{name}", c)
    ranged = keyed.repartitionByRange(n, *seg, *order).withColumn(_PID, F.spark_partition_id())
    # Both branches below must see the same partition ids; re-running the
    # input (shuffle output order varies) would re-sample the range bounds.
    # A reliable checkpoint in the shared folder fixes them once and cuts
    # the lineage, so a lost executor re-reads instead of re-planning.
    checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    local_w = (Window.partitionBy(_PID, *segment).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    aggf = {"sum": F.sum, "max": F.max}
    local = ranged
    for name, (_, how) in values.items():
        local = local.withColumn(f"_l_{name}", aggf[how](f"_v_{name}").over(local_w))
    # per (partition, segment) totals; only the first/last segment of a
    # partition can continue elsewhere, but the table stays one row per pair
    totals = ranged.groupBy(_PID, *segment).agg(
        *[aggf[how](f"_v_{name}").alias(f"_t_{name}") for name, (_, how) in values.items()])
    prev_w = Window.partitionBy(*segment).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *segment, *[aggf[how](f"_t_{name}").over(prev_w).alias(f"_o_{name}")
                                               for name, (_, how) in values.items()])
    # rows without a segment (null) are a segment too
    keys = [_PID, *segment]
    offsets = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_o_{name}" for name in values])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = local.join(offsets if segment else F.broadcast(offsets), same, "left").drop(*[f"_k_{k}" for k in keys])
    for name, (_, how) in values.items():
        lv, ov = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        comb = (lv + F.coalesce(ov, F.lit(0))) if how == "sum" else F.greatest(lv, ov)
        out = out.withColumn(name, comb)
    drop = [_PID] + [f"_{p}_{name}" for name in values for p in ("v", "l", "o")]
    return out.drop(*drop)
