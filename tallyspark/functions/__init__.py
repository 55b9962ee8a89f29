"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from .money import money, money_sum, money_mean, half_even, py_round, safe_pct
from .dates import weekday, month_key, month_start, iso_week, is_weekend, weekday_name
from .text import clean_text, counted, currency_label, ratio_band, status_band

__all__ = [
    "money", "money_sum", "money_mean", "half_even", "py_round", "safe_pct",
    "weekday", "month_key", "month_start", "iso_week", "is_weekend", "weekday_name",
    "clean_text", "counted", "currency_label", "ratio_band", "status_band",
]
