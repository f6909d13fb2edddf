"""Null-safe date and time expressions (ANSI mode is assumed to be on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.44
SECONDS_PER_DAY = 86400.0


def safe_date(text: Column) -> Column:
    """Date from the first ten characters of an ISO string, else null."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head).try_cast("date")


def safe_timestamp(text: Column) -> Column:
    """Timestamp from an ISO string with zone (``Z`` allowed), else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text).try_cast("timestamp")


def age_days(as_of: Column, ts: Column) -> Column:
    """Fractional days from ``ts`` to ``as_of``, never negative."""
    micros = F.unix_micros(as_of) - F.unix_micros(ts)
    return F.greatest(micros / F.lit(SECONDS_PER_DAY * 1e6), F.lit(0.0))


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age / F.lit(half_life))
