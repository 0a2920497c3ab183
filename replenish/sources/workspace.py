"""Workspace: a catalog of named tables, role detection and the table summary
(S9, N1-N8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.functions.naming import infer_role, normalize_columns, normalize_name, pick_tables
from replenish.params import PlanParams


class Workspace:
    """Tables by normalised name; a later source overwrites an equal name
    (sample -> upload -> database, as the caller adds them)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.overrides: dict[str, str | None] = {}

    def add(self, name: str, df: DataFrame, normalize: bool = True) -> "Workspace":
        key = normalize_name(name) if normalize else name
        self.tables[key] = df.toDF(*normalize_columns(df.columns)) if normalize else df
        return self

    def update(self, tables: dict[str, DataFrame]) -> "Workspace":
        for k, v in tables.items():
            self.add(k, v, normalize=False)
        return self

    def set_role(self, role: str, table: str | None) -> "Workspace":
        """Override the detected table of a role (all six roles)."""
        self.overrides[role] = table
        return self

    def roles(self) -> dict[str, str | None]:
        r = pick_tables({k: v.columns for k, v in self.tables.items()})
        r.update(self.overrides)
        return r

    def role_tables(self) -> dict[str, DataFrame | None]:
        return {role: (self.tables.get(name) if name else None) for role, name in self.roles().items()}

    def summary(self) -> DataFrame:
        """Rows, columns, inferred role and whether the table was picked."""
        picked = {v: k for k, v in self.roles().items() if v}
        parts = []
        for name in sorted(self.tables):
            df = self.tables[name]
            parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
                F.lit(infer_role(name, df.columns)).alias("inferred_role"),
                F.lit(picked.get(name, "")).alias("detected_role")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def model(self, params: PlanParams | None = None, **kw):
        from replenish.plans.model import SupplyModel
        return SupplyModel(self.spark, self.role_tables(), params or PlanParams(), **kw)
