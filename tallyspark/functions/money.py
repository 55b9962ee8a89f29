"""Exact money arithmetic.

Amounts are doubles in storage.  Sums run in DECIMAL(28,6), so that the
addition order (partitioning, AQE coalescing, partial aggregation) cannot
change a single bit of the result, then return to double.  A group with an
amount that has no such decimal (1e22 and more, not a number) is summed in
double instead; other groups are not affected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col) -> Column:
    """The amount as a decimal; NULL where it does not fit."""
    return _c(col).try_cast(MONEY)


def unfit(col) -> Column:
    """Whether an amount has no decimal form."""
    return _c(col).isNotNull() & money(col).isNull()


def money_sum(col) -> Column:
    """Order-independent sum; 0 for a group without amounts (pandas)."""
    exact = F.coalesce(F.sum(money(col)).cast("double"), F.lit(0.0))
    return F.when(F.max(unfit(col)), F.sum(_c(col))).otherwise(exact)


def money_mean(col) -> Column:
    """Sum / count as double; NULL for a group without amounts."""
    return F.try_divide(money_sum(col), F.count(_c(col)))


def half_even(col, digits: int = 2) -> Column:
    """NumPy/pandas rounding: half-even on the scaled double (``rint``)."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def py_round(col, digits: int = 2) -> Column:
    """Python's ``round(x, digits)``: half-even on the exact binary value.

    ``x * scale`` is taken with its exact error (the number split in two
    halves of 26 bits), which decides where the product alone looks like a
    tie.  Products of 2**52 and more have no fraction and stay as they are."""
    x, scale = _c(col).cast("double"), F.lit(float(10 ** digits))
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    p = x * scale
    err = (hi * scale - p) + (x - hi) * scale
    low = F.floor(p).cast("double")
    d = p - low - F.lit(0.5)
    up = (d > 0) | ((d == 0) & ((err > 0) | ((err == 0) & (low % 2 != 0))))
    return F.when(F.abs(p) < F.lit(4503599627370496.0), F.when(up, low + 1.0).otherwise(low) / scale).otherwise(x)


def safe_pct(num, den) -> Column:
    """num / den * 100, NULL when den is 0 or NULL (never raises)."""
    return F.try_divide(_c(num), _c(den)) * F.lit(100.0)
