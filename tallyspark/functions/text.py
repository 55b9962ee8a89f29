"""String expressions: note cleaning and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import let
from .money import py_round
from ..schema import BAND_OK, BAND_WARN, CURRENCY, RATIO_OK, RATIO_WARN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """lower -> drop everything but ASCII letters, digits, whitespace ->
    collapse whitespace runs to one space -> trim.  A null note becomes the
    text 'none' exactly as ``str(None).lower()`` would."""
    s = F.lower(F.coalesce(_c(col), F.lit("None")))
    # (?U): whitespace is Unicode-aware, as in Python's ``re`` on str.
    # after lower() no A-Z remains; deleting whole runs is the same text, faster
    s = F.regexp_replace(s, r"(?U)[^a-z0-9\s]+", "")
    # a blank alone stays what it is
    s = F.regexp_replace(s, r"(?U)\s{2,}|[^\S ]", " ")
    return F.trim(s)


def currency_label(col, symbol: str = CURRENCY) -> Column:
    """>= 100,000 -> 'x.xL'; >= 1,000 -> 'x.xK'; else whole number with
    thousands separators.  Digits as Python formats them (exact value)."""
    x = _c(col)
    one_dec = lambda v: F.format_string("%.1f", py_round(v, 1))
    return (
        F.when(x >= 100000, F.concat(F.lit(symbol), one_dec(x / 100000), F.lit("L")))
        .when(x >= 1000, F.concat(F.lit(symbol), one_dec(x / 1000), F.lit("K")))
        .otherwise(F.concat(F.lit(symbol), F.format_number(F.rint(x), 0)))
    )


def status_band(pct, ok: float = BAND_OK, warn: float = BAND_WARN) -> Column:
    """Budget utilisation band: below ``ok`` -> ok, below ``warn`` -> warn, else over."""
    p = _c(pct)
    return F.when(p < ok, "ok").when(p < warn, "warn").otherwise("over")


def ratio_band(value, max_value, reverse: bool = False, ok: float = RATIO_OK,
               warn: float = RATIO_WARN) -> Column:
    """Band of value / max_value (0 when max_value <= 0): below ``ok`` ->
    ok, below ``warn`` -> warn, else over; ``reverse`` uses 1 - ratio."""
    v, m = _c(value), _c(max_value)
    r = F.when(m > 0, v / m).otherwise(F.lit(0.0))
    if reverse:
        r = F.lit(1.0) - r
    return F.when(r < ok, "ok").when(r < warn, "warn").otherwise("over")


def counted(words: Column) -> Column:
    """(token, tf) of an array of words: runs of the sorted array."""
    def runs(w: Column) -> Column:
        first = F.filter(F.transform(w, lambda t, i: F.when((i == 0) | (t != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(w, i).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(w)) - i).cast("long").alias("tf"))))
    return let(F.sort_array(words), runs)
