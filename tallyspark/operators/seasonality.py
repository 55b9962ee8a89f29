"""Seasonal pattern with a strength (R2): iterated decomposition of a series.

``y = trend + season + rest`` by key: the trend is a centred moving average
over one period, the season the mean detrended value of each phase, centred
to zero.  A further pass takes the trend of the deseasonalised series (whose
average may shrink at the ends) and the season anew.  The strength of the
season is ``max(0, 1 - var(rest) / var(season + rest))``: 0 is none, 1 is all.

All windows run over an aggregated series (one row for each key and day or
month) and share one partitioning by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_even

#: variances below this share of the mean square are rounding, not variation
NOISE = 1e-18


def _centred(y: str, w: Window, period: int) -> Column:
    """Mean over one period centred on the row (an even one: half weights at
    both ends); NULL where the frame leaves the series."""
    h = period // 2
    if period % 2:
        f = w.rowsBetween(-h, h)
        return F.when(F.count(y).over(f) == period, F.sum(y).over(f) / period)
    both = F.sum(y).over(w.rowsBetween(-h, h - 1)) + F.sum(y).over(w.rowsBetween(-h + 1, h))
    return F.when(F.count(y).over(w.rowsBetween(-h, h)) == period + 1, both / (2 * period))


def decompose(series: DataFrame, phase: Column, period: int, keys: Sequence[str] = ("user_id",),
              passes: int = 2) -> DataFrame:
    """(key..., ds, y, phase, trend, season, rest) for each row of a gap-free
    ``series`` (key..., ds, y).  ``phase`` is the place of a row in its period.

    Trend and rest are NULL where the first pass has no whole frame and no
    second one follows.  A phase that no row with a trend shows has season 0.
    Keys may be few or none (then one window holds the series)."""
    keys = list(keys)
    every = Window.partitionBy(*keys)
    w, by_phase = every.orderBy("ds"), Window.partitionBy(*keys, "phase")
    d = series.select(*keys, "ds", F.col("y").cast("double").alias("y"), phase.alias("phase"))
    h = period // 2
    for i in range(max(passes, 1)):
        if i == 0:
            d = d.withColumn("trend", _centred("y", w, period))
        else:
            d = (d.withColumn("__calm", F.col("y") - F.col("season"))
                 .withColumn("trend", F.avg("__calm").over(w.rowsBetween(-h, h))).drop("__calm"))
        d = d.withColumn("__off", F.col("y") - F.col("trend"))
        d = d.withColumn("season", F.avg("__off").over(by_phase))
        # every phase counts once in the level that is taken away
        d = d.withColumn("__nth", F.row_number().over(by_phase.orderBy("ds")))
        level = F.avg(F.when(F.col("__nth") == 1, F.col("season"))).over(every)
        d = d.withColumn("season", F.coalesce(F.col("season") - level, F.lit(0.0))).drop("__off", "__nth")
    return d.withColumn("rest", F.col("y") - F.col("trend") - F.col("season"))


def seasonal_strength(series: DataFrame, phase: Column, period: int, keys: Sequence[str] = ("user_id",),
                      passes: int = 2) -> DataFrame:
    """(key..., n_rows, strength, peak_phase, peak_season, low_phase,
    low_season), a row for each key.

    Series of less than two whole periods, or without variation beside the
    trend, have no strength (NULL) and no phases.  Equal seasons: the smaller
    phase.  Figures are rounded to 6 places."""
    keys = list(keys)
    d = decompose(series, phase, period, keys, passes)
    off, s = F.col("y") - F.col("trend"), half_even("season", 6)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.var_pop(off).alias("__all"),
        F.var_pop("rest").alias("__rest"), F.avg(F.col("y") * F.col("y")).alias("__sq"),
        F.max(F.struct(s.alias("v"), (-F.col("phase")).alias("p"))).alias("__hi"),
        F.min(F.struct(s.alias("v"), F.col("phase").alias("p"))).alias("__lo"))
    ok = (F.col("n_rows") >= 2 * period) & (F.col("__all") > F.col("__sq") * NOISE)
    return g.select(
        *keys, "n_rows",
        F.when(ok, half_even(F.greatest(F.lit(0.0), 1 - F.col("__rest") / F.col("__all")), 6)).alias("strength"),
        F.when(ok, -F.col("__hi.p")).alias("peak_phase"), F.when(ok, F.col("__hi.v")).alias("peak_season"),
        F.when(ok, F.col("__lo.p")).alias("low_phase"), F.when(ok, F.col("__lo.v")).alias("low_season"))
