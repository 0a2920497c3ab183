"""Typed coercions used by standardisation (ANSI-safe: always try_cast)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_double(df: DataFrame, name: str | None) -> Column:
    """Numeric coercion; unparsable values become NULL."""
    if name is None:
        return F.lit(None).cast("double")
    t = _dtype(df, name)
    if isinstance(t, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(t, T.BooleanType):
        return F.col(name).cast("double")
    return F.col(name).cast("string").try_cast("double")


def as_double_or(df: DataFrame, name: str | None, default: float) -> Column:
    return F.coalesce(as_double(df, name), F.lit(float(default)))


def as_date(df: DataFrame, name: str | None) -> Column:
    """Date coercion (day-truncated); unparsable values become NULL."""
    if name is None:
        return F.lit(None).cast("date")
    t = _dtype(df, name)
    c = F.col(name)
    if isinstance(t, T.DateType):
        return c
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return F.to_date(F.try_to_timestamp(c.cast("string")))


def as_text(name: str | None, default: str) -> Column:
    """String coercion; missing column or NULL value -> documented default."""
    if name is None:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(default))
