"""Cleaning chain for dirty transaction sources.

Lookups against the fixed mapping tables are literal ``map`` expressions
(a handful of entries), evaluated inside whole-stage codegen: no join, no
shuffle.  The one data-dependent lookup, note -> dominant category (J1), is
a join of the rows against a one-row-per-note table; a note carrying a
large share of all rows is spread over sub-keys (``skew.salted_join``).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text as clean_text_expr
from ..functions import weekday_name
from ..schema import (AMOUNT_CAP, CATEGORY_MAP, INVALID_NOTES, INVESTMENT, INVESTMENT_MODES,
                      MANUAL_CATEGORY, MERGED_CATEGORIES, MISSING, PAYMENT_MAP, RAW_COLUMNS,
                      SENTINEL_AMOUNTS)
from ..session import materialize
from .reports import dominant_category, note_category_counts
from .skew import salted_join

# second source's column names -> common names
RENAME_B = {"Date": "date", "Category": "category", "Amount": "amount", "Note": "notes",
            "Income/Expense": "transaction_type", "Mode": "payment_mode"}

# accepted date texts, tried in order
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy"]


# what pandas and Python read as a number (the JVM would also take 12d or 1f)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(col: Column) -> Column:
    """Double of a numeric text, else NULL."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def _lookup(mapping: dict[str, str], col: Column) -> Column:
    """Exact-match replace: mapped value, else the value itself."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(m, col), col)


def rename_columns(df: DataFrame, mapping: dict[str, str] = RENAME_B) -> DataFrame:
    """Project the second source onto the common column names."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])


def union_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """B1: UNION ALL by name (duplicates kept)."""
    return a.select(*RAW_COLUMNS).unionByName(b.select(*RAW_COLUMNS))


def fill_missing(df: DataFrame, cols=("notes", "category", "payment_mode"),
                 value: str = MISSING) -> DataFrame:
    """Missing notes / category / payment mode -> 'unknown'."""
    return df.fillna(value, subset=list(cols))


def drop_missing(df: DataFrame, cols=("amount", "date")) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))


def coerce_amount(df: DataFrame, col: str = "amount") -> DataFrame:
    """Text -> double; unparsable -> NULL (never raises under ANSI)."""
    return df.withColumn(col, parse_number(F.col(col)))


def coerce_date(df: DataFrame, col: str = "date", formats=DATE_FORMATS) -> DataFrame:
    """Text -> DATE trying each format in turn; unparsable -> NULL."""
    parsed = F.coalesce(*[F.try_to_timestamp(F.col(col), F.lit(f)) for f in formats])
    return df.withColumn(col, parsed.cast("date"))


def normalise_payment_mode(df: DataFrame) -> DataFrame:
    """Spelling variants -> Cash / UPI / Card / Bank Transfer, savings
    accounts -> Bank Account, investment instruments -> Investment."""
    mapping = dict(PAYMENT_MAP)
    mapping.update({m: INVESTMENT for m in INVESTMENT_MODES})
    return df.withColumn("payment_mode", _lookup(mapping, F.col("payment_mode")))


def normalise_category(df: DataFrame) -> DataFrame:
    """C4: lower-case, then fix the known typos."""
    return df.withColumn("category", _lookup(CATEGORY_MAP, F.lower(F.col("category"))))


def resolve_note_category(df: DataFrame) -> DataFrame:
    """Every row takes its note's most frequent category (ties: the
    smallest category).  Notes with a single category keep it, so applying
    it to all notes equals applying it to the conflicted ones.  A note
    holding a large share of the rows is split over sub-keys (``salted_join``).
    The small (note, category, n) table is written once, when the frame is
    built; winner, rows per note and hot notes all come from it, so the input
    is read twice in all."""
    counts = materialize(note_category_counts(df), "note_counts")
    dom = dominant_category(df, counts).select("notes", "dominant_category")
    per_note = counts.groupBy("notes").agg(F.sum("n").alias("_n"))
    return (salted_join(df, dom, ["notes"], "left", counts=per_note)
            .withColumn("category", F.coalesce(F.col("dominant_category"), F.col("category")))
            .drop("dominant_category")
            .select(*df.columns))


def manual_category_override(df: DataFrame, mapping: dict[str, str] = MANUAL_CATEGORY) -> DataFrame:
    """A fixed set of exact notes force their category."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return df.withColumn("category", F.coalesce(F.try_element_at(m, F.col("notes")),
                                                F.col("category")))


def drop_invalid_notes(df: DataFrame, invalid=INVALID_NOTES) -> DataFrame:
    """Drop junk notes and null notes."""
    return df.filter(F.col("notes").isNotNull() & ~F.col("notes").isin(list(invalid)))


def add_clean_notes(df: DataFrame, src: str = "notes", dst: str = "clean_notes") -> DataFrame:
    """Normalised note text."""
    return df.withColumn(dst, clean_text_expr(src))


def merge_rare_categories(df: DataFrame, mapping: dict[str, str] = MERGED_CATEGORIES) -> DataFrame:
    """Fold small categories into larger ones."""
    return df.withColumn("category", _lookup(mapping, F.col("category")))


def date_parts(df: DataFrame, col: str = "date") -> DataFrame:
    """Year, month, day and weekday name."""
    return (df.withColumn("year", F.year(col)).withColumn("month", F.month(col))
            .withColumn("day", F.dayofmonth(col)).withColumn("weekday", weekday_name(col)))


def drop_amount_outliers(df: DataFrame, cap: float = AMOUNT_CAP) -> DataFrame:
    """P5: drop sentinels, negatives, zeros and amounts above the cap; the
    five filters of the notebook reduce to 0 < amount <= cap (the sentinels
    lie above the cap) and Catalyst pushes it into the scan."""
    return df.filter((F.col("amount") > 0) & (F.col("amount") <= cap))


def outlier_audit(df: DataFrame, cap: float = AMOUNT_CAP) -> DataFrame:
    """Counts behind P5, one pass."""
    a = F.col("amount")
    return df.agg(F.count_if(a == SENTINEL_AMOUNTS[0]).alias("n_sentinel_999999999"),
                  F.count_if(a == SENTINEL_AMOUNTS[1]).alias("n_sentinel_999999"),
                  F.count_if(a < 0).alias("n_negative"),
                  F.count_if(a > cap).alias("n_over_cap"),
                  F.count_if(a == 0).alias("n_zero"),
                  F.count(F.lit(1)).alias("n_rows"))


# --- the chain ------------------------------------------------------------

def combine_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """P8 + B1 + C1 + P7 + C2 + lower category + P7: the loaded frame."""
    u = union_datasets(a, rename_columns(b))
    u = drop_missing(fill_missing(u), ["amount"])
    u = drop_missing(coerce_amount(u), ["amount"])
    u = u.withColumn("category", F.lower("category"))
    return drop_missing(u, ["date"])


def mapped(a: DataFrame, b: DataFrame) -> DataFrame:
    """... + C5 + C4: the frame whose note conflicts J1 resolves."""
    return normalise_category(normalise_payment_mode(combine_sources(a, b)))


def clean_transactions(a: DataFrame, b: DataFrame, cap: float = AMOUNT_CAP,
                       expense_only: bool = False) -> DataFrame:
    """C11: the whole chain in the reference's order (J1 writes its small
    count table when the frame is built, the rest is lazy): P8 B1 C1 P7 C2 C5 C4 J1 C6 P4 C8 C7 C3 D1 P5.  The reference keeps
    income rows (Q8); ``expense_only`` drops them first."""
    m = mapped(a, b)
    if expense_only:
        m = m.filter(F.col("transaction_type") == "Expense")
    df = resolve_note_category(m)
    df = drop_invalid_notes(manual_category_override(df))
    df = merge_rare_categories(add_clean_notes(df))
    df = date_parts(coerce_date(df))
    return drop_amount_outliers(df, cap)


def distinct_note_category(df: DataFrame) -> DataFrame:
    """B2: distinct (clean_notes, category) pairs."""
    return df.select("clean_notes", "category").dropDuplicates()
