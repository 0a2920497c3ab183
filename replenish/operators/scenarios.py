"""What-if scenarios evaluated in one job.

Demand is computed once, unscaled; the scenario table (a handful of
parameter rows) is exploded next to every planning row as a literal array --
a narrow Generate, no join -- and the reorder formulas run as column
expressions per scenario, followed by one combinable aggregation."""

from __future__ import annotations

import uuid

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.functions import planning as P
from replenish.operators.reorder import reorder_columns
from replenish.params import PlanParams


@dataclass(frozen=True)
class Scenario:
    name: str
    demand_multiplier: float = 1.0
    lead_time_delay: float = 0.0
    service_level: float = 0.95


def grid(multipliers=(0.8, 1.0, 1.2), delays=(0.0, 5.0, 10.0), service_level: float = 0.95) -> list[Scenario]:
    return [Scenario(f"x{m:g} +{d:g}d", float(m), float(d), float(service_level)) for m in multipliers for d in delays]


def scenario_rows(position_unscaled: DataFrame, scenarios: list[Scenario], params: PlanParams) -> DataFrame:
    """Every planning row under every scenario (reorder maths per row)."""
    arr = F.array(*[F.struct(F.lit(s.name).alias("name"), F.lit(s.demand_multiplier).alias("m"),
                             F.lit(s.lead_time_delay).alias("d"), F.lit(s.service_level).alias("sl"))
                    for s in scenarios])
    c = F.col
    x = position_unscaled.select("*", F.explode(arr).alias("sc"))
    x = (x.withColumn("avg_daily_demand", c("avg_daily_demand") * c("sc.m"))
         .withColumn("std_daily_demand", c("std_daily_demand") * c("sc.m"))
         # the scenario's delay replaces the one the position was built with
         .withColumn("lead_time_days", c("lead_time_days") + (c("sc.d") - F.lit(float(params.lead_time_delay_days)))))
    return reorder_columns(x, params, z=P.z_col(c("sc.sl")))


def scenario_summary(rows: DataFrame) -> DataFrame:
    """Per scenario the values a saved scenario keeps."""
    c = F.col
    return rows.groupBy(c("sc.name").alias("name")).agg(
        F.first("sc.m").alias("demand_multiplier"), F.first("sc.d").alias("lead_time_delay"),
        F.first("sc.sl").alias("service_level"),
        F.sum("inventory_value").alias("total_inventory_value"),
        F.coalesce(F.sum(F.when(c("recommended_order_qty") > 0, c("recommended_order_value"))), F.lit(0.0)).alias("recommended_order_value"),
        F.count(F.when(c("stockout_risk") == P.RISK_CRITICAL, 1)).alias("critical_skus"))


def upsert(saved: DataFrame, new: DataFrame) -> DataFrame:
    """W2 save: replace scenarios of the same name, keep the others."""
    return saved.join(new.select("name"), "name", "left_anti").unionByName(new)


class ScenarioStore:
    """W2 over sessions: saved scenarios as a versioned table. A save reads the
    current version, writes the next one into a folder of its own and then
    adds a pointer: an empty file whose name holds a number and the version.
    Readers take the pointer with the highest number, so they see one whole
    version or the other, and a writer that fails leaves the old
    one. Versions have random names, so two savers never write into one
    folder; of two that save at once the one with the greater pointer wins."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def current(self) -> str | None:
        """The version that the pointer names: the last of the pointer files."""
        found = self._fs.globStatus(self._hadoop(f"{self.path}/current-*"))
        names = sorted(f.getPath().getName() for f in found or ())
        return names[-1].split("-", 2)[2] if names else None

    def read(self):
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def save(self, new) -> str:
        """Upsert by name; returns the new version."""
        before = self.read()
        rows = new if before is None else upsert(before, new)
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{version}")
        found = self._fs.globStatus(self._hadoop(f"{self.path}/current-*"))
        last = max((int(f.getPath().getName().split("-")[1]) for f in found or ()), default=0)
        # creating an empty file is atomic in every store; its name is the pointer
        self._fs.createNewFile(self._hadoop(f"{self.path}/current-{last + 1:012}-{version}"))
        return version


def scenario_long(summary: DataFrame) -> DataFrame:
    """Long form of the two value columns."""
    return summary.unpivot(["name"], ["total_inventory_value", "recommended_order_value"], "metric", "value")
