"""Calendar expressions with pandas' conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weekday(col) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``; not Spark ``dayofweek``)."""
    return F.weekday(_c(col))


def weekday_name(col) -> Column:
    """English weekday name (Monday ... Sunday); NULL for a NULL date."""
    return F.date_format(_c(col), "EEEE")


def is_weekend(col) -> Column:
    return weekday(col) >= 5


def month_key(col) -> Column:
    """``yyyy-MM`` text key of a date."""
    return F.date_format(_c(col), "yyyy-MM")


def month_start(col) -> Column:
    return F.trunc(_c(col), "month")


def iso_week(col) -> Column:
    """ISO-8601 week number (1..53)."""
    return F.weekofyear(_c(col))
