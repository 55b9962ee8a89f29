"""Daily and monthly series features.

A series is ``(key..., ds, y)``.  Every window here runs over an already
aggregated series (one row per key and day or month), so a window
partition is bounded by the calendar, not by how many transactions a key
has.  All lags and rolling frames share one ``partitionBy(key).orderBy(ds)``
spec, i.e. one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_even, money
from .reports import daily_totals

DAILY_LAGS = [1, 2, 3, 7, 14]
MONTHLY_LAGS = [1, 2, 3]


def _w(keys: list[str], order: str = "ds") -> Window:
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def calendar_columns(c: Column) -> dict[str, Column]:
    """Weekday (Mon=0), month, day, quarter, day of year, ISO week, weekend."""
    return {"dayofweek": F.weekday(c), "month": F.month(c), "day": F.dayofmonth(c), "quarter": F.quarter(c),
            "dayofyear": F.dayofyear(c), "weekofyear": F.weekofyear(c), "is_weekend": (F.weekday(c) >= 5).cast("int")}


def calendar_features(df: DataFrame, col: str = "ds") -> DataFrame:
    """The calendar's columns of a date column."""
    for name, c in calendar_columns(F.col(col)).items():
        df = df.withColumn(name, c)
    return df


def month_start_from_parts(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """First-of-month date from year and month, and its quarter."""
    ms = F.make_date(F.col(year), F.col(month), F.lit(1))
    return df.withColumn("month_start", ms).withColumn("quarter", F.quarter(ms))


def future_days(series: DataFrame, periods: int, keys=("user_id",)) -> DataFrame:
    """The next ``periods`` days after each key's last day."""
    last = series.groupBy(*keys).agg(F.max("ds").alias("_last"))
    return last.select(*keys, F.explode(F.sequence(F.date_add("_last", 1),
                                                   F.date_add("_last", periods))).alias("ds"))


def future_months(series: DataFrame, periods: int, keys=()) -> DataFrame:
    """The next ``periods`` month starts after each key's last month."""
    last = series.groupBy(*keys).agg(F.max("ds").alias("_last"))
    return last.select(*keys, F.explode(F.sequence(
        F.add_months("_last", 1), F.add_months("_last", periods),
        F.expr("INTERVAL 1 MONTH"))).alias("ds"))


def calendar_gap_fill(series: DataFrame, keys=("user_id",)) -> DataFrame:
    """Every day from each key's first to last day; missing days -> 0.

    The day grid is generated per key (bounded by the key's date span) and
    equi-joined back to the observed days."""
    keys = list(keys)
    span = series.groupBy(*keys).agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("ds"))
    return (grid.join(series.select(*keys, "ds", "y"), keys + ["ds"], "left")
            .withColumn("y", F.coalesce(F.col("y"), F.lit(0.0))))


def month_gap_fill(series: DataFrame, keys=("user_id",)) -> DataFrame:
    """Every month start from each key's first to last one; missing -> 0."""
    keys = list(keys)
    span = series.groupBy(*keys).agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("ds"))
    return (grid.join(series.select(*keys, "ds", "y"), keys + ["ds"], "left")
            .withColumn("y", F.coalesce(F.col("y"), F.lit(0.0))))


def _mean(col: str, w: Window) -> Column:
    """Windowed mean over exact money sums."""
    return F.sum(money(col)).over(w).cast("double") / F.count(col).over(w)


def lag_features(df: DataFrame, lags=DAILY_LAGS, keys=("user_id",), order: str = "ds",
                 y: str = "y", prefix: str = "lag_") -> DataFrame:
    """Y shifted by each lag within the key, in ``order``."""
    w = _w(list(keys), order)
    for k in lags:
        df = df.withColumn(f"{prefix}{k}", F.lag(y, k).over(w))
    return df


def rolling_strict(df: DataFrame, sizes=(7, 14), keys=("user_id",), order: str = "ds",
                   y: str = "y", prefix: str = "rolling_") -> DataFrame:
    """Mean over exactly ``n`` rows ending at the current one (NULL before)."""
    base = _w(list(keys), order)
    for n in sizes:
        w = base.rowsBetween(-(n - 1), 0)
        df = df.withColumn(f"{prefix}{n}", F.when(F.count(y).over(w) == n, _mean(y, w)))
    return df


def rolling_partial(df: DataFrame, sizes=(7, 14), std_size: int = 7, keys=("user_id",),
                    order: str = "ds", y: str = "y") -> DataFrame:
    """Means with ``min_periods=1`` and a sample std (1 row -> 0)."""
    base = _w(list(keys), order)
    for n in sizes:
        df = df.withColumn(f"rolling_mean_{n}", _mean(y, base.rowsBetween(-(n - 1), 0)))
    ws = base.rowsBetween(-(std_size - 1), 0)
    return df.withColumn(f"rolling_std_{std_size}",
                         half_even(F.coalesce(F.stddev_samp(y).over(ws), F.lit(0.0)), 6))


def feature_table_daily(expenses: DataFrame) -> DataFrame:
    """Observed-day features (no gap filling), rows with a null lag dropped."""
    d = calendar_features(daily_totals(expenses))
    d = rolling_partial(lag_features(d))
    return d.dropna(subset=[f"lag_{k}" for k in DAILY_LAGS])


def feature_table_daily_gapfilled(expenses: DataFrame) -> DataFrame:
    """Gap-filled daily features with strict rolling means, nulls dropped."""
    d = calendar_features(calendar_gap_fill(daily_totals(expenses)))
    d = rolling_strict(lag_features(d))
    return d.dropna(subset=[f"lag_{k}" for k in DAILY_LAGS] + ["rolling_7", "rolling_14"])


def monthly_series(expenses: DataFrame, keys=()) -> DataFrame:
    """Monthly totals indexed by month start (``ds``), undated rows dropped.

    With no keys this is the notebook's single all-user series: a partial
    aggregation down to one row per month."""
    d = expenses.filter(F.col("date").isNotNull())
    return (d.groupBy(*keys, F.trunc("date", "month").alias("ds"))
            .agg(F.sum(money("amount")).cast("double").alias("y")))


def feature_table_monthly(series: DataFrame, keys=()) -> DataFrame:
    """month/year/quarter, lags 1-3, strict rolling 3 and 6; nulls dropped.

    Without keys the window has no partition: it orders the monthly series,
    one row per calendar month, which stays small at any data size."""
    d = (series.withColumn("month_num", F.month("ds")).withColumn("year_num", F.year("ds"))
         .withColumn("quarter", F.quarter("ds")))
    d = lag_features(d, MONTHLY_LAGS, keys)
    d = rolling_strict(d, (3, 6), keys)
    return d.dropna()


def temporal_holdout(df: DataFrame, test_rows: int = 6, keys=(), order: str = "ds") -> DataFrame:
    """The last ``test_rows`` rows of each series are 'test', the rest 'train'."""
    keys = list(keys)
    w = (Window.partitionBy(*keys).orderBy(F.col(order).desc()) if keys
         else Window.orderBy(F.col(order).desc()))
    return (df.withColumn("_rn", F.row_number().over(w))
            .withColumn("split", F.when(F.col("_rn") <= test_rows, "test").otherwise("train"))
            .drop("_rn"))


def last_n(df: DataFrame, n: int, keys=("user_id",), order: str = "ds") -> DataFrame:
    """The last ``n`` rows of each series (``WindowGroupLimit`` plan)."""
    keys = list(keys)
    w = (Window.partitionBy(*keys).orderBy(F.col(order).desc()) if keys
         else Window.orderBy(F.col(order).desc()))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
