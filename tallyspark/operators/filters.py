"""Scans, filters and the history view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ALL


def _given(v) -> bool:
    return v is not None and v != ALL


def filter_expenses(df: DataFrame, start: str | None = None, end: str | None = None,
                    category: str | None = None, payment_mode: str | None = None,
                    user_id: int | None = None) -> DataFrame:
    """Optional inclusive date range, category and payment mode
    ('All' or None = no filter).  Plain column predicates: Catalyst pushes
    them into the Parquet scan (``PushedFilters``)."""
    if user_id is not None:
        df = df.filter(F.col("user_id") == F.lit(user_id))
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    if _given(category):
        df = df.filter(F.col("category") == F.lit(category))
    if _given(payment_mode):
        df = df.filter(F.col("payment_mode") == F.lit(payment_mode))
    return df


def search_notes(df: DataFrame, pattern: str | None) -> DataFrame:
    """Case-insensitive regex search in notes; a null note never matches."""
    if not pattern:
        return df
    return df.filter(F.coalesce(F.col("notes").rlike("(?i)" + pattern), F.lit(False)))


SORTS = {"date_desc": ("date", False), "date_asc": ("date", True),
         "amount_desc": ("amount", False), "amount_asc": ("amount", True)}


def expense_history(df: DataFrame, search: str | None = None, category: str | None = None,
                    payment_mode: str | None = None, sort: str = "date_desc") -> DataFrame:
    """Filtered, searched, sorted history projected to the table columns."""
    h = search_notes(filter_expenses(df, category=category, payment_mode=payment_mode), search)
    col, asc = SORTS[sort]
    key = F.col(col).asc() if asc else F.col(col).desc()
    return (h.select("user_id", "id", "date", "category", "amount", "payment_mode", "notes")
            .orderBy("user_id", key, "id"))


def scan_expenses(df: DataFrame, user_id: int | None = None) -> DataFrame:
    """A user's expenses newest first (all users when ``user_id`` is None)."""
    return filter_expenses(df, user_id=user_id).orderBy(
        "user_id", F.col("date").desc(), F.col("id").desc())


def scan_budgets(budgets: DataFrame, month: str, user_id: int | None = None) -> DataFrame:
    """Budgets of a month (and user).  Written partitioned by ``month``,
    the month predicate prunes whole directories."""
    b = budgets.filter(F.col("month") == F.lit(month))
    return b.filter(F.col("user_id") == F.lit(user_id)) if user_id is not None else b
