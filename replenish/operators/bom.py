"""Dependent demand through all levels of a bill of materials.

Low-level codes by frontier iteration: SKUs that are no component have their
own demand and code 0; a component is ready, with its whole dependent demand
and a code one above its deepest parent's, as soon as no open recipe row
leads to it. Every round joins the frontier with the open rows, sums what
flows (map-side first, so a part that goes into everything is combined
before the shuffle), and closes those rows; the number of rounds is the depth
of the recipes. Rows that stay open hang on a cycle, which raises.

Each round is written to the shared checkpoint folder: lineage ends there
and only emptiness tests reach the driver. Recipe rows without a parent or a
component are left out, repeated rows count each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.operators.position import DEMAND_COLS
from replenish.session import scratch_path


class CyclicBom(ValueError):
    """Recipes that need themselves."""


def multilevel_demand(base: DataFrame, bom: DataFrame) -> DataFrame:
    """(sku, low_level_code, dep_...): one row per component of ``bom`` (parent_sku, component_sku, qty_required) with the demand
    that its parents' demand in ``base`` causes, level by level."""
    c, spark = F.col, bom.sparkSession
    folder = scratch_path(spark, "bom")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    known = c("parent_sku").isNotNull() & c("component_sku").isNotNull()
    open_ = written(bom.where(known).select("parent_sku", "component_sku", "qty_required"), "open/round=0")
    own = base.groupBy(c("sku").alias("own_sku")).agg(*[F.sum(x).alias(f"own_{x}") for x in DEMAND_COLS])
    tops = open_.select(c("parent_sku").alias("sku")).distinct().join(open_.select(c("component_sku").alias("sku")), "sku", "left_anti")
    ready = written(tops.join(own, c("sku") == c("own_sku"), "left")
                    .select("sku", *[F.coalesce(f"own_{x}", F.lit(0.0)).alias(x) for x in DEMAND_COLS]), "ready/level=0")
    flows, level = [], 0
    while not ready.isEmpty():
        level += 1
        moving = open_.join(ready, open_["parent_sku"] == ready["sku"])
        flows.append(written(moving.groupBy(c("component_sku").alias("sku")).agg(*[F.sum(c(x) * c("qty_required")).alias(x) for x in DEMAND_COLS]),
                             f"flows/level={level}"))
        open_ = written(open_.join(ready.select(c("sku").alias("parent_sku")), "parent_sku", "left_anti"), f"open/round={level}")
        # whoever got its last flow now, with all flows of the rounds before
        closed = flows[-1].select("sku").join(open_.select(c("component_sku").alias("sku")), "sku", "left_anti")
        whole = flows[0]
        for f in flows[1:]:
            whole = whole.union(f)
        ready = written(whole.join(closed, "sku", "left_semi").groupBy("sku").agg(*[F.sum(x).alias(x) for x in DEMAND_COLS]), f"ready/level={level}")
    stuck = open_.select("component_sku").distinct().orderBy("component_sku").limit(5).collect()
    if stuck:
        raise CyclicBom("recipes in a cycle, or below one: " + ", ".join(r[0] for r in stuck))
    levels = spark.read.option("basePath", f"{folder}/ready").schema(
        "sku string, " + ", ".join(f"{x} double" for x in DEMAND_COLS) + ", level int").parquet(f"{folder}/ready")
    return levels.where("level > 0").select("sku", c("level").alias("low_level_code"), *[c(x).alias(f"dep_{x}") for x in DEMAND_COLS])
