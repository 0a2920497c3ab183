"""Number-to-text helpers that print like Python format specs.

``format_number`` rounds the exact binary value half-to-even, which is what
Python's ``{:,.2f}`` does; ``format_string('%.2f')`` would round the shortest
decimal form half-up and disagree on ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from replenish.functions.planning import dround

# Values are first rounded to this many decimals so that last-bit noise from
# summation order (which depends on partitioning) cannot change the text.
CLEAN_DECIMALS = 6


def _special(x: Column, body: Column) -> Column:
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(body))


def fmt_grouped(x: Column, decimals: int = 2) -> Column:
    """Python ``f"{x:,.Nf}"``."""
    return _special(x, F.format_number(dround(x, CLEAN_DECIMALS), decimals))


def fmt_fixed(x: Column, decimals: int = 1) -> Column:
    """Python ``f"{x:.Nf}"``."""
    return _special(x, F.regexp_replace(F.format_number(dround(x, CLEAN_DECIMALS), decimals), ",", ""))


def fmt_int(x: Column) -> Column:
    """Python ``str(int(x))`` (truncation toward zero)."""
    return x.cast("long").cast("string")


def fmt_int_grouped(x: Column) -> Column:
    """Python ``f"{int(x):,}"``."""
    return F.format_number(x.cast("long"), 0)


def py_float_str(x: Column) -> Column:
    """Python ``str(float)`` for moderate magnitudes (e.g. scores 0-100)."""
    return _special(x, x.cast("string"))
