"""Array-expression algebra and the seasonal regression against NumPy."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyspark.functions.linalg import cholesky, gram, solve
from tallyspark.operators.forecast import seasonal_trend_regression
from tallyspark.schema import INTERVAL_Z80


def test_gram_factor_and_solution(spark):
    rng = np.random.default_rng(4)
    for n, p in ((12, 1), (30, 7), (60, 25)):
        x, y = rng.normal(size=(n, p)), rng.normal(size=n)
        df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<array<double>>, y array<double>")
        xx, xy = gram(F.col("x"), F.col("y"))
        df = df.withColumn("xx", xx).withColumn("xy", xy).withColumn("l", cholesky(F.col("xx")))
        row = df.select("xx", "xy", "l", solve(F.col("l"), F.col("xy")).alias("b")).first()
        assert np.allclose(row.xx, x.T @ x, atol=1e-10) and np.allclose(row.xy, x.T @ y, atol=1e-10)
        lower = np.linalg.cholesky(x.T @ x)
        assert all(np.allclose(r, lower[i, :i + 1], atol=1e-9) for i, r in enumerate(row.l))
        assert np.allclose(row.b, np.linalg.solve(x.T @ x, x.T @ y), atol=1e-8)


def plain_regression(ds, y, periods, changepoints=25):
    """The same model in NumPy."""
    ds, y = pd.DatetimeIndex(ds), np.asarray(y)
    span = max((ds[-1] - ds[0]).days, 1)
    t = (ds - ds[0]).days.to_numpy() / span
    cps = np.quantile(t[:max(int(len(t) * 0.8), 1)], np.linspace(0, 1, changepoints + 2)[1:-1])

    def design(days):
        s = (days - ds[0]).days.to_numpy() / span
        cols = [np.ones_like(s), s] + [np.maximum(0, s - c) for c in cps]
        cols += [f(2 * np.pi * k * days.dayofweek.to_numpy() / 7) for k in (1, 2, 3) for f in (np.sin, np.cos)]
        if span >= 730:
            cols += [f(2 * np.pi * k * days.dayofyear.to_numpy() / 365.25) for k in range(1, 11) for f in (np.sin, np.cos)]
        return np.column_stack(cols)

    x = design(ds)
    penalty = np.ones(x.shape[1])
    penalty[:2] = 0
    beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y)
    half = INTERVAL_Z80 * np.std(y - x @ beta, ddof=1)
    future = pd.date_range(ds[-1] + pd.Timedelta(days=1), periods=periods)
    p = design(future) @ beta
    return {d.date(): (max(v, 0), max(v - half, 0), v + half) for d, v in zip(future, p)}


def test_regression_equals_numpy(spark):
    """Short history, gaps, and two years (yearly waves) side by side."""
    rng = np.random.default_rng(9)
    start = dt.date(2022, 1, 1)
    data = {}
    for user, (n, step) in enumerate([(10, 1), (45, 1), (60, 3), (800, 1)]):
        days = [start + dt.timedelta(days=i * step) for i in range(n)]
        data[user] = (days, [float(50 + 0.1 * i + 20 * (d.weekday() >= 5) + rng.normal() * 5) for i, d in enumerate(days)])
    rows = [(u, d, v) for u, (ds, y) in data.items() for d, v in zip(ds, y)]
    series = spark.createDataFrame(rows, "user_id long, ds date, y double")
    fc = seasonal_trend_regression(series, periods=11)
    plan = fc._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Join" not in plan
    got = {(r.user_id, r.ds): (r.yhat, r.yhat_lower, r.yhat_upper) for r in fc.collect()}
    assert len(got) == 44
    for u, (ds, y) in data.items():
        for d, want in plain_regression(ds, y, 11).items():
            assert np.allclose(got[u, d], want, rtol=1e-8, atol=1e-8), (u, d)


def test_short_series_have_no_changepoints(spark):
    rows = [(1, dt.date(2024, 1, 1), 3.0), (1, dt.date(2024, 1, 2), 5.0)]
    out = seasonal_trend_regression(spark.createDataFrame(rows, "user_id long, ds date, y double"), 2, min_history=1).collect()
    assert len(out) == 2 and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)
