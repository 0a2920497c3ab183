"""Sinks (K1-K6). Every writer is an executor-side write of a DataFrame;
documents that are one JSON object hold only bounded parts (playbooks,
first alerts) and point to the unbounded tables written next to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.functions.planning import INF

# Bundle folder per model table (the original workbook's sheet names).
BUNDLE_NAMES = {
    "inventory_health": "inventory_health", "reorder_plan": "reorder_plan", "supplier_risk": "supplier_risk",
    "anomalies": "anomalies", "sku_returns": "sku_returns", "supplier_returns": "supplier_returns",
    "transfers": "transfers", "bom": "bom_recipes", "freight_comparisons": "freight_optimization",
    "financial_kpis": "financial_kpis", "automation_playbooks": "automation", "report": "report",
}
# Approval policy block of the automation payload.
APPROVAL_POLICY = (("auto_create_po", False), ("auto_send_supplier_email", False),
                   ("require_human_approval_for_order_value_above", 0), ("safe_mode", True))


def json_safe(df: DataFrame) -> DataFrame:
    """inf / NaN -> NULL, dates and timestamps -> text (K2 rules)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, order=None) -> None:
    """K1: header CSV; ``order`` gives a total order across part files."""
    out = df.orderBy(*order) if order else df
    json_safe(out).write.mode("overwrite").option("header", True).csv(path)


def write_audit(tables: dict[str, DataFrame], path: str, cap: int | None = None, orders: dict | None = None) -> None:
    """K2: one JSON-lines folder per table; ``cap`` keeps the first rows of a
    table in its own deterministic order (off by default: whole tables)."""
    for name, df in tables.items():
        out = df
        if cap is not None:
            out = out.orderBy(*(orders or {}).get(name, out.columns)).limit(cap)
        json_safe(out).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """K3 (re-aimed from a workbook): one folder per sheet name; a table
    without rows gets none."""
    for key, df in tables.items():
        if df.isEmpty():
            continue
        name = BUNDLE_NAMES.get(key, key)
        w = json_safe(df).write.mode("overwrite")
        (w.option("header", True).csv if fmt == "csv" else w.parquet)(f"{path.rstrip('/')}/{name}")


#: CSV that tells null from the empty text: null is \\N (a text of these two
#: characters is lost; line ends inside a text need another format).
CSV = {"header": True, "quoteAll": True, "escape": '"', "nullValue": "\\N", "emptyValue": ""}
WRITERS = {"csv": lambda w: w.options(**CSV).csv,
           "json": lambda w: w.option("ignoreNullFields", False).json, "parquet": lambda w: w.parquet}


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """One folder per table and a manifest of them: (name, format, rows, columns),
    columns being the table's schema as DDL. The rows are counted while they
    are written. The manifest is written last, so a folder without one is
    unfinished."""
    spark, told = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        safe, seen = json_safe(df), Observation()
        writer = safe.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        WRITERS[fmt](writer)(f"{path.rstrip('/')}/{name}")
        told.append((name, fmt, seen.get["rows"], safe.schema.toDDL()))
    manifest = spark.createDataFrame(told, MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_manifest")
    return manifest


MANIFEST = "name string, format string, rows long, columns string"


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a folder that ``write_tables`` wrote, with their schemas;
    raises if a table has not the rows that the manifest names."""
    out = {}
    for m in spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/_manifest").collect():  # a row per table
        reader = spark.read.schema(m["columns"])
        if m["format"] == "csv":
            reader = reader.options(**CSV)
        df = getattr(reader, m["format"])(f"{path.rstrip('/')}/{m['name']}")
        # every column's values are read, so that a part that can't be parsed is seen
        found = df.select(F.struct("*").alias("row")).agg(F.count("row").alias("n")).first()["n"]
        if found != m["rows"]:
            raise ValueError(f"{path}: {m['name']} has {found} rows, its manifest says {m['rows']}")
        out[m["name"]] = df
    return out


def automation_payload(playbooks: DataFrame, alerts: DataFrame, transfers_path: str, source: str = "replenish",
                       webhook_url: str = "", alert_cap: int = 100) -> DataFrame:
    """K4: one-row frame with the payload JSON. Alerts are limited to the
    first ``alert_cap`` in queue order; the transfer list is referenced by
    path (written with ``write_audit``) instead of being folded into one row."""
    pb = playbooks.agg(F.collect_list(F.struct(*playbooks.columns)).alias("automation_playbooks"))
    top = alerts.orderBy("alert_group", "rank").limit(alert_cap)
    al = top.agg(F.array_sort(F.collect_list(F.struct("alert_group", "rank", *[c for c in alerts.columns
                                                                             if c not in ("alert_group", "rank")])))
                 .alias("alerts")).scalar()
    policy = F.struct(*[F.lit(v).alias(k) for k, v in APPROVAL_POLICY])
    doc = F.struct(F.lit(source).alias("source"), F.lit(webhook_url).alias("webhook_url_placeholder"),
                   F.col("automation_playbooks"), al.alias("alerts"), F.lit(transfers_path).alias("transfers_path"),
                   policy.alias("approval_policy"))
    return pb.select(F.to_json(doc).alias("payload"))


def write_report(lines: DataFrame, path: str) -> None:
    """K5: the report lines (a bounded, small frame) as one text file."""
    lines.orderBy("section", "item").select("text").coalesce(1).write.mode("overwrite").text(path)


def preview(df: DataFrame, order, n: int = 500) -> DataFrame:
    """K6: first ``n`` rows in ``order``; dates as text, infinities as the
    infinity sign."""
    top = df.orderBy(*order).limit(n)
    cols = []
    for f in top.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.abs(c) == F.lit(INF), F.lit("∞")).otherwise(c.cast("string"))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return top.select(*cols)
