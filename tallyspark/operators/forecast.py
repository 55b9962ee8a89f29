"""Forecasting for every user at once.

- ``trailing_mean_forecast`` (M2) is what the reference's UI tree path really
  emits: each future day is the mean of the last 7 values of the gap-filled,
  extended series.  Per user it is one fixed-size array recursion
  (``aggregate`` over the horizon) — no loop, no Python.
- ``seasonal_trend_forecast`` (M6/M7, tier 1) is an additive model: a
  least-squares trend from exact integer/decimal sums, plus mean residual per
  weekday (and per month of year with two years of history) kept as small
  per-user maps, with an 80 % normal band.  The series is shuffled once by
  user; the rest are per-user aggregates and joins on that partitioning.
- ``seasonal_trend_regression`` (M6 tier 2) fits changepoint hinges and
  Fourier terms per user: Gram matrix, Cholesky factor and solution are array
  expressions over the daily series.
- The boosted-tree forecasts live in ``operators.models``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_even, py_round, weekday_name
from ..functions.linalg import add_diagonal, cholesky, dot, gram, let, solve
from ..schema import BAND, INTERVAL_Z80, MIN_HISTORY, PAGE_MIN_HISTORY, PAGE_TREE_DAYS
from ..session import materialize
from .reports import daily_totals
from .series import calendar_gap_fill, last_n

USER = "user_id"


def _sum_arr(arr):
    """Left-to-right sum of a double array (0 for empty)."""
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def eligible(series: DataFrame, min_rows: int, keys=(USER,), min_days: int = 0
             ) -> tuple[DataFrame, DataFrame]:
    """M1 guard: (series of keys with >= ``min_rows`` rows over >=
    ``min_days`` calendar days, skipped keys with the reason).  One window
    over the aggregated series, bounded by the calendar."""
    w = Window.partitionBy(*keys)
    s = (series.withColumn("n_points", F.count(F.lit(1)).over(w))
         .withColumn("_days", F.datediff(F.max("ds").over(w), F.min("ds").over(w)) + 1))
    short = F.col("n_points") < min_rows
    bad = short | (F.col("_days") < min_days)
    reason = (F.when(short, F.lit(f"fewer than {min_rows} data points"))
              .otherwise(F.lit(f"fewer than {min_days} calendar days")))
    skipped = (s.filter(bad).groupBy(*keys, "n_points", "_days").agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, "n_points", reason.alias("reason")))
    return s.filter(~bad).select(*series.columns), skipped


def trailing_mean_forecast(expenses: DataFrame, periods: int = 30, window: int = 7,
                           min_history: int = PAGE_MIN_HISTORY["trees"],
                           min_days: int = PAGE_TREE_DAYS) -> DataFrame:
    """M2: recursive trailing mean with +-20 % bounds, per user with at
    least ``min_history`` observed and ``min_days`` calendar days (with fewer
    the reference has no training row and refuses)."""
    # the daily series feeds the gap fill and the seed: written once, when the
    # frame is built
    daily, _ = eligible(materialize(daily_totals(expenses), "daily"), min_history, min_days=min_days)
    seed = last_n(calendar_gap_fill(daily), window)
    s = seed.groupBy(USER).agg(
        F.max("ds").alias("last_ds"),
        F.transform(F.sort_array(F.collect_list(F.struct("ds", "y"))), lambda r: r["y"])
        .alias("vals"))
    step = lambda acc, i: F.concat(acc, F.array(
        _sum_arr(F.slice(acc, -window, window)) / F.size(F.slice(acc, -window, window))))
    ext = s.withColumn("ext", F.aggregate(F.sequence(F.lit(1), F.lit(periods)),
                                          F.col("vals"), step))
    preds = F.slice("ext", F.size("vals") + 1, periods)
    out = ext.select(USER, "last_ds", F.posexplode(preds).alias("pos", "yhat"))
    return out.select(USER, F.date_add("last_ds", F.col("pos") + 1).alias("ds"), "yhat",
                      (F.col("yhat") * (1 - BAND)).alias("yhat_lower"),
                      (F.col("yhat") * (1 + BAND)).alias("yhat_upper"))


# --- seasonal trend (tier 1) ------------------------------------------------

def _t(unit: str):
    """Integer time index from the series origin: days or months."""
    return (F.datediff("ds", "origin") if unit == "day"
            else F.months_between("ds", "origin").cast("int"))


GLOBAL = "_g"


def _attach(frame: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Add a per-key table's columns to ``frame``: an equi-join on the keys,
    or, for the single all-key series, one scalar struct subquery (the
    table has one row) instead of a join on a constant."""
    if keys == [GLOBAL]:
        cols = [c for c in table.columns if c != GLOBAL]
        st = table.select(F.struct(*cols)).scalar()
        return frame.select("*", *[st[c].alias(c) for c in cols])
    return frame.join(table, keys)


def seasonal_trend_fit(series: DataFrame, keys: list[str], unit: str = "day",
                       min_history: int = 0) -> tuple[DataFrame, DataFrame]:
    """Trend and seasonal effects per key from exact sums.

    The series is shuffled once, by key (the window below); every later
    aggregate and join is per key and reuses that partitioning.  t and
    cents are integers, so n, sum t, sum t^2, sum y, sum t*y are exact
    (DECIMAL) whatever the partitioning; the line and the seasonal means
    (mean trend residual per weekday / month of year, kept as small maps
    of 7 / 12 entries) follow by a fixed sequence of double operations.
    Yearly effects apply only with two years of history.

    Returns (model: one row per key, rows: the eligible series with t)."""
    w = Window.partitionBy(*keys)
    s = (series.withColumn("origin", F.min("ds").over(w))
         .withColumn("last_ds", F.max("ds").over(w))
         .withColumn("_rows", F.count(F.lit(1)).over(w)))
    if min_history:
        s = s.filter(F.col("_rows") >= min_history)
    s = (s.withColumn("t", _t(unit).cast("decimal(38,0)"))
         .withColumn("cents", F.round(F.col("y") * 100).cast("decimal(38,0)")))
    # the sums, both effects and the residuals read the series: written once,
    # when the frame is built
    s = materialize(s, "series")
    g = s.groupBy(*keys).agg(
        F.min("origin").alias("origin"), F.max("last_ds").alias("last_ds"),
        F.count(F.lit(1)).cast("decimal(38,0)").alias("n"),
        F.sum("t").alias("St"), F.sum(F.col("t") * F.col("t")).alias("Stt"),
        F.sum("cents").alias("SY"), F.sum(F.col("t") * F.col("cents")).alias("StY"))
    num = (F.col("n") * F.col("StY") - F.col("St") * F.col("SY")).cast("double")
    den = (F.col("n") * F.col("Stt") - F.col("St") * F.col("St")).cast("double")
    g = g.withColumn("b", F.when(den != 0, num / den / 100.0).otherwise(F.lit(0.0)))
    g = g.withColumn("a", (F.col("SY").cast("double") / 100.0
                           - F.col("b") * F.col("St").cast("double")) / F.col("n").cast("double"))
    params = g.select(*keys, "a", "b", "origin", "last_ds",
                      (F.datediff("last_ds", "origin") >= 730).alias("yearly"))

    def effect(expr, name):
        e = (s.withColumn("_k", expr).groupBy(*keys, "_k")
             .agg(F.count(F.lit(1)).cast("double").alias("_n"),
                  F.sum("cents").cast("double").alias("_sy"), F.sum("t").cast("double").alias("_st")))
        e = _attach(e, params.select(*keys, "a", "b"), keys).select(
            *keys, "_k", (F.col("_sy") / 100.0 / F.col("_n")
                          - (F.col("a") + F.col("b") * (F.col("_st") / F.col("_n")))).alias("_e"))
        return e.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("_k", "_e"))).alias(f"{name}_map"))

    model = _attach(params, effect(F.month("ds"), "year"), keys)
    if unit == "day":
        model = _attach(model, effect(F.weekday("ds"), "week"), keys)
    return model, s.select(*keys, "ds", "y")


def _fitted(frame: DataFrame, model: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Trend + weekly effect (daily data) + yearly effect (when on)."""
    f = _attach(frame, model, keys)
    comp = F.col("a") + F.col("b") * _t(unit).cast("double")
    if unit == "day":
        comp = comp + F.coalesce(F.try_element_at("week_map", F.weekday("ds")), F.lit(0.0))
    comp = comp + F.when(F.col("yearly"), F.coalesce(F.try_element_at("year_map", F.month("ds")),
                                                     F.lit(0.0))).otherwise(0.0)
    return f.withColumn("fitted", comp)


def seasonal_trend_forecast(series: DataFrame, periods: int = 30, keys=(USER,), unit: str = "day",
                            min_history: int = MIN_HISTORY["seasonal"], digits: int = 4,
                            future: DataFrame | None = None) -> DataFrame:
    """M6/M7 tier 1: trend + weekly (daily data) + yearly (two years of
    history) seasonality with an 80 % normal band from the residual spread;
    yhat and lower clipped at 0, upper not.  ``future`` overrides the
    default next ``periods`` days / months (e.g. a holdout's dates)."""
    keys = list(keys)
    glob = not keys
    if glob:  # one all-key series: parameters attach as scalars (see _attach)
        series = series.withColumn(GLOBAL, F.lit(0))
        keys = [GLOBAL]
        future = future.withColumn(GLOBAL, F.lit(0)) if future is not None else None
    # the aggregated series feeds the fit, the residuals and the forecast:
    # materialise it once (reliable checkpoint) instead of once per branch
    series = materialize(series.select(*keys, "ds", "y"), "series")
    model, rows = seasonal_trend_fit(series, keys, unit, 0 if glob else min_history)
    hist = _fitted(rows, model, keys, unit)
    sig = hist.groupBy(*keys).agg(
        F.coalesce(F.stddev_samp(F.col("y") - F.col("fitted")), F.lit(0.0)).alias("sigma"))
    if future is None:
        if unit == "day":
            seq = F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", periods))
        else:
            seq = F.sequence(F.add_months("last_ds", 1), F.add_months("last_ds", periods),
                             F.expr("INTERVAL 1 MONTH"))
        future = model.select(*keys, F.explode(seq).alias("ds"))
    f = _attach(_fitted(future.select(*keys, "ds"), model, keys, unit), sig, keys)
    half = F.lit(INTERVAL_Z80) * F.col("sigma")
    out_keys = [] if glob else keys
    return f.select(*out_keys, "ds",
                    half_even(F.greatest(F.col("fitted"), F.lit(0.0)), digits).alias("yhat"),
                    half_even(F.greatest(F.col("fitted") - half, F.lit(0.0)), digits)
                    .alias("yhat_lower"),
                    half_even(F.col("fitted") + half, digits).alias("yhat_upper"))


# --- summaries of a forecast (M8-M10, M13) ----------------------------------

def forecast_summary(fc: DataFrame, keys=(USER,)) -> DataFrame:
    """M8: total and mean of yhat (rounded 2), peak and lowest day."""
    return fc.groupBy(*keys).agg(
        py_round(F.sum("yhat")).alias("total_predicted"),
        py_round(F.avg("yhat")).alias("avg_daily"),
        F.min_by("ds", F.struct((-F.col("yhat")).alias("v"), F.col("ds").alias("d")))
        .alias("peak_day"),
        F.max("yhat").alias("peak_yhat"),
        F.min_by("ds", F.struct(F.col("yhat").alias("v"), F.col("ds").alias("d")))
        .alias("low_day"),
        F.min("yhat").alias("low_yhat"))


def forecast_trend(fc: DataFrame, keys=(USER,), k: int = 7) -> DataFrame:
    """M9: % change of the mean of the last ``k`` vs the first ``k``
    predictions (only with more than ``k`` rows; 0 if the first mean <= 0)."""
    keys = list(keys)
    wa = Window.partitionBy(*keys).orderBy("ds")
    wd = Window.partitionBy(*keys).orderBy(F.col("ds").desc())
    r = fc.withColumn("_a", F.row_number().over(wa)).withColumn("_d", F.row_number().over(wd))
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                             F.avg(F.when(F.col("_a") <= k, F.col("yhat"))).alias("first_week"),
                             F.avg(F.when(F.col("_d") <= k, F.col("yhat"))).alias("last_week"))
    pct = F.when(F.col("first_week") > 0,
                 (F.col("last_week") - F.col("first_week")) / F.col("first_week") * 100
                 ).otherwise(F.lit(0.0))
    return g.filter(F.col("n") > k).select(*keys, half_even("first_week", 4).alias("first_week"),
                                           half_even("last_week", 4).alias("last_week"),
                                           half_even(pct, 4).alias("trend_pct"))


def forecast_table(fc: DataFrame) -> DataFrame:
    """Date, weekday name, predicted value and band."""
    return fc.select(USER, "ds", weekday_name("ds").alias("day"), "yhat", "yhat_lower",
                     "yhat_upper")


def history_plus_forecast(expenses: DataFrame, fc: DataFrame, history_days: int = 60) -> DataFrame:
    """The last ``history_days`` observed days and the forecast, one frame."""
    hist = last_n(daily_totals(expenses), history_days)
    h = hist.select(USER, "ds", F.lit("history").alias("kind"), F.col("y").alias("value"),
                    F.lit(None).cast("double").alias("lower"),
                    F.lit(None).cast("double").alias("upper"))
    f = fc.select(USER, "ds", F.lit("forecast").alias("kind"), F.col("yhat").alias("value"),
                  F.col("yhat_lower").alias("lower"), F.col("yhat_upper").alias("upper"))
    return h.unionByName(f)


def dispatch_guard(expenses: DataFrame, model: str, path: str = "service") -> tuple[DataFrame, DataFrame]:
    """M1: (daily series long enough for ``model``, skipped users) with the
    limits of the service or of the page."""
    if path not in ("service", "page") or model not in MIN_HISTORY:
        raise ValueError(f"Unknown model: {model} ({path})")
    least = (MIN_HISTORY if path == "service" else PAGE_MIN_HISTORY)[model]
    days = PAGE_TREE_DAYS if (path, model) == ("page", "trees") else 0
    ok, skipped = eligible(daily_totals(expenses), least, min_days=days)
    return ok, skipped.withColumn("model", F.lit(model)).withColumn("path", F.lit(path))


def forecast_dispatch(expenses: DataFrame, model: str = "seasonal", periods: int = 30,
                      path: str = "service") -> tuple[DataFrame, DataFrame]:
    """M1: choose a model by name; series too short go to ``skipped``
    with a reason instead of raising.  Returns (forecast, skipped).  The
    service's tree model is fitted when the frame is built."""
    daily, skipped = dispatch_guard(expenses, model, path)
    if model == "seasonal":
        fc = seasonal_trend_forecast(daily, periods, min_history=0)
    elif path == "page":
        fc = trailing_mean_forecast(expenses, periods)
    else:
        from .models import boosted_tree_forecast
        fc = boosted_tree_forecast(expenses, periods)
    return fc, skipped


# --- seasonal trend, tier 2: a regression for each user ----------------------

def _design(t: Column, ds: Column, cps: Column, yearly: Column, weekly_order: int, yearly_order: int) -> Column:
    """A design row: 1, time, hinges, weekly and (if on) yearly waves."""
    def waves(angle: Column, order: int) -> Column:
        return F.array(*[f(angle * float(k)) for k in range(1, order + 1) for f in (F.sin, F.cos)])

    week = waves(F.weekday(ds) * (2 * math.pi / 7), weekly_order)
    year = F.when(yearly, waves(F.dayofyear(ds) * (2 * math.pi / 365.25), yearly_order)).otherwise(F.array().cast("array<double>"))
    hinges = F.transform(cps, lambda c: F.greatest(F.lit(0.0), t - c))
    return F.concat(F.array(F.lit(1.0), t), hinges, week, year)


def _quantiles(sorted_values: Column, n: int) -> Column:
    """``n`` evenly spaced inner quantiles of a sorted array, interpolated."""
    def at(q: float) -> Column:
        place = (F.size(sorted_values) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
        return a + (b - a) * (place - low)
    return F.array(*[at((k + 1) / (n + 1)) for k in range(n)]) if n else F.array().cast("array<double>")


def seasonal_trend_regression(series: DataFrame, periods: int = 30,
                              min_history: int = MIN_HISTORY["seasonal"], n_changepoints: int = 25,
                              weekly_order: int = 3, yearly_order: int = 10, ridge: float = 1.0
                              ) -> DataFrame:
    """M6 tier 2: per user, a regularised least-squares fit of a piecewise
    linear trend (hinges at changepoints over the first 80 % of history)
    plus weekly and, with two years of history, yearly Fourier terms.

    One shuffle gathers a user's *daily* series in an array, bounded by the
    calendar (days of history), not by how many transactions the user has.
    The Gram matrix, its Cholesky factor, the solution and the forecast are
    array expressions of that row: no Python worker and no join."""
    # a number of its own: sized by bytes, the few small rows of all users would share a task
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series, _ = eligible(series.repartition(parts, USER), min_history)
    user = (series.groupBy(USER).agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("days"))
            .select(USER, F.col("days.ds").alias("ds"), F.col("days.y").alias("y"),
                    F.get("days.ds", 0).alias("start"), F.element_at("days.ds", -1).alias("last_ds")))
    span = F.greatest(F.datediff("last_ds", "start"), F.lit(1))
    user = user.withColumn("span", span.cast("double")).withColumn("yearly", span >= 730)

    def time(ds: Column) -> Column:
        return F.datediff(ds, F.col("start")) / F.col("span")

    user = user.withColumn("t", F.transform("ds", time))
    early = F.slice("t", F.lit(1), F.greatest(F.floor(F.size("t") * F.lit(0.8)).cast("int"), F.lit(1)))
    user = user.withColumn("early", early).withColumn(
        "cps", F.when(F.size("t") > 2, _quantiles(F.col("early"), n_changepoints)).otherwise(F.array().cast("array<double>")))

    def row(ds: Column) -> Column:
        return _design(time(ds), ds, F.col("cps"), F.col("yearly"), weekly_order, yearly_order)

    user = user.withColumn("x", F.transform("ds", row))
    xx, xy = gram(F.col("x"), F.col("y"))

    def shrunk(m: Column) -> Column:
        # intercept and base slope are not shrunk
        return add_diagonal(m, F.transform(F.get(m, 0), lambda _, i: F.when(i < 2, 0.0).otherwise(ridge)))

    # ``let``: the penalty reads the Gram matrix once more, and must not make it anew
    user = user.withColumn("xy", xy).withColumn("a", let(xx, shrunk))
    user = user.withColumn("lower", cholesky(F.col("a"))).withColumn("beta", solve(F.col("lower"), F.col("xy")))
    user = user.withColumn("e", F.zip_with("x", "y", lambda r, y: y - dot(r, F.col("beta"))))
    n = F.size("e")
    mean = F.aggregate("e", F.lit(0.0), lambda s, v: s + v) / n
    spread = let(mean, lambda m: F.aggregate("e", F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
    user = user.withColumn("sigma", F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).otherwise(0.0))
    out = (user.select(USER, "beta", "sigma", "start", "span", "cps", "yearly",
                       F.explode(F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", periods))).alias("ds"))
           .withColumn("fitted", dot(row(F.col("ds")), F.col("beta"))))
    half = F.lit(INTERVAL_Z80) * F.col("sigma")
    return out.select(USER, "ds", F.greatest(F.col("fitted"), F.lit(0.0)).alias("yhat"),
                      F.greatest(F.col("fitted") - half, F.lit(0.0)).alias("yhat_lower"),
                      (F.col("fitted") + half).alias("yhat_upper"))
