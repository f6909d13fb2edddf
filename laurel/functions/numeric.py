"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def flag(cond: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it is false or null."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def scaled(x: Column, lo: Column, hi: Column, eps: float = 1e-12) -> Column:
    """Min-max scaling; all zero when the spread is below ``eps``."""
    return F.when(hi - lo < eps, F.lit(0.0)).otherwise((x - lo) / (hi - lo))


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of digits, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits))


def number_or_zero(column: Column) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(0.0))
