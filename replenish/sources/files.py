"""File sources (S1-S3): CSV, JSON, Parquet by suffix.

CSV is read with every column as a string; standardisation then applies
``try_cast`` per field, so key columns with gaps never turn into floats."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replenish.functions.naming import normalize_columns, normalize_name
from replenish.sources.json_array import read_json_array


def _norm(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_columns(df.columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, all columns as strings, headers normalised."""
    return _norm(spark.read.option("header", True).option("inferSchema", False).csv(path))


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """S3: an array of records or JSON lines. An array is split at its
    records' borders (``json_array``); ``multi_line=True`` takes Spark's own
    reader, one task per file.

    A column-oriented object ({"col": {"0": v, ...}}) is not a record
    layout and is rejected."""
    if multi_line is None:
        # one character reaches the driver, however long the first line is
        first = spark.read.text(path).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).where("c != ''").first()
        array = first is not None and first[0] == "["
    else:
        array = False
    df = read_json_array(spark, path) if array else spark.read.option("multiLine", bool(multi_line)).json(path)
    nested = [f.dataType.fieldNames() for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
    if df.columns and len(nested) == len(df.columns) and all(n.isdigit() for names in nested for n in names):
        raise ValueError(f"{path}: column-oriented JSON is not a record layout")
    if df.columns == ["_corrupt_record"] or not df.columns:
        raise ValueError(f"{path}: not a JSON array of records or JSON lines")
    return _norm(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _norm(spark.read.parquet(path))


def load_dir(spark: SparkSession, base_dir: str, pattern: str = "*.csv") -> dict[str, DataFrame]:
    """One table per file of a folder, or per folder of part files in
    it, named by the normalised stem, visited in sorted order. Hadoop's file
    systems list the folder (names only), so it may lie in any store."""
    out = {}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base_dir).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.globStatus(path(base_dir)):
        raise FileNotFoundError(base_dir)
    listed = [x.getPath() for x in fs.globStatus(path(base_dir, pattern)) or []]
    for p in sorted(x.toString() for x in listed if not x.getName().startswith(("_", "."))):
        out[normalize_name(os.path.splitext(os.path.basename(p))[0])] = read_csv(spark, p)
    return out


def load_files(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Files by suffix."""
    out: dict[str, DataFrame] = {}
    for p in paths:
        stem = normalize_name(os.path.splitext(os.path.basename(p))[0])
        suffix = os.path.splitext(p)[1].lower()
        if suffix == ".csv":
            out[stem] = read_csv(spark, p)
        elif suffix == ".json":
            out[stem] = read_json(spark, p)
        elif suffix == ".parquet":
            out[stem] = read_parquet(spark, p)
    return out
