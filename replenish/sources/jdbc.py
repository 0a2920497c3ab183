"""Relational pulls (S4, S5, S7, S8) through Spark's JDBC source.

Table names are whitelisted before they reach ``dbtable``; the catalog key is
the part after the last dot. Reads are split over ``num_partitions`` ranges
of a numeric column when one is given. The original's row cap is available
as ``row_limit`` but off by default: a planner over whole tables must not
truncate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from replenish.functions.naming import check_identifier, normalize_columns, table_key

DB_URL_CONF = "spark.replenish.dbUrl"


def db_url(spark: SparkSession) -> str:
    """The database URL configured on the session ('' when unset)."""
    return (spark.conf.get(DB_URL_CONF, "") or "").strip()


def jdbc_reader(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
                properties: dict | None = None):
    r = spark.read.format("jdbc").option("url", url).option("dbtable", check_identifier(table))
    if partition_column and num_partitions:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r


def jdbc_tables(spark: SparkSession, url: str, tables_csv: str, row_limit: int | None = None,
                **partitioning) -> dict[str, DataFrame]:
    """One lazy DataFrame per listed table."""
    if not url.strip() or not tables_csv.strip():
        return {}
    out = {}
    for name in [x.strip() for x in tables_csv.split(",") if x.strip()]:
        df = jdbc_reader(spark, url, name, **partitioning).load()
        if row_limit is not None:
            df = df.orderBy(*df.columns).limit(int(row_limit))  # the same rows each time
        out[table_key(name)] = df.toDF(*normalize_columns(df.columns))
    return out
