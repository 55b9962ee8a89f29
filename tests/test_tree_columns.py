"""Tree ensembles as columns, and recursions, against the library and plain
Python."""

import datetime as dt
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tallyspark.operators import models as T
from tallyspark.operators.reports import daily_totals
from tallyspark.operators.tree_columns import tree_columns

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-5, 5), rng.choice([0.0, 1.0, float("nan")]), float(rng.randint(0, 9))) for _ in range(400)]
    return spark.createDataFrame([(*r, r[0] * (r[1] if r[1] == r[1] else 3) + r[2] ** 2) for r in rows], "a double, b double, c double, y double").cache()


@pytest.mark.parametrize("stage", [
    lambda: GBTRegressor(labelCol="y", maxIter=12, maxDepth=4, stepSize=0.2, subsamplingRate=0.7, seed=3),
    lambda: RandomForestRegressor(labelCol="y", numTrees=7, maxDepth=5, seed=3),
    lambda: DecisionTreeRegressor(labelCol="y", maxDepth=3),
    lambda: GBTRegressor(labelCol="y", maxIter=2, maxDepth=0, seed=3)])
def test_equals_the_library(spark, points, stage):
    model = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep"), stage()]).fit(points.filter("NOT isnan(b)"))
    out = model.transform(points).withColumn("mine", tree_columns(model).predict(F.array(*NAMES)))
    assert out.filter("abs(mine - prediction) > 1e-9 * (1 + abs(prediction)) OR mine IS NULL").count() == 0
    plan = out.select("mine")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def expenses(spark, days=((0, 40), (1, 20), (2, 12))):
    rng = random.Random(2)
    rows = [(u * 1000 + i, u, dt.date(2024, 1, 1) + dt.timedelta(days=i), "a", float(rng.randint(1, 90)), "Cash", "")
            for u, n in days for i in range(n)]
    return spark.createDataFrame(rows, "id long, user_id long, date date, category string, amount double, payment_mode string, notes string")


def plain_features(vals, ds):
    iso = ds.isocalendar()
    f = {"month": ds.month, "day": ds.day, "dayofweek": ds.weekday(), "quarter": (ds.month + 2) // 3,
         "dayofyear": ds.timetuple().tm_yday, "weekofyear": iso[1], "is_weekend": int(ds.weekday() >= 5)}
    f |= {f"lag_{k}": vals[-k] for k in (1, 2, 3, 7, 14)}
    m6, m13 = vals[-6:], vals[-13:]
    mean = sum(m6) / 6
    return f | {"rolling_mean_7": mean, "rolling_mean_14": sum(m13) / 13,
                "rolling_std_7": (sum((x - mean) ** 2 for x in m6) / 5) ** 0.5}


def test_horizon_equals_a_step_by_step_loop(spark):
    e = expenses(spark)
    daily = daily_totals(e)
    train = T.feature_table_daily(e)
    model = T.fit_trees(train, T.DAILY_FEATURES, maxIter=10, maxDepth=4, stepSize=0.3, seed=1)
    fc = T.daily_recursion(daily, T.tree_predictor(model, T.DAILY_FEATURES), periods=9)
    got = {(r.user_id, r.ds): (r.yhat, r.yhat_lower, r.yhat_upper) for r in fc.collect()}
    library = model.stages[-1]
    series = {}
    for r in sorted(daily.collect(), key=lambda r: (r.user_id, r.ds)):
        series.setdefault(r.user_id, []).append((r.ds, r.y))
    assert len(got) == 27
    for user, rows in series.items():
        last, vals = rows[-1][0], [y for _, y in rows]
        for k in range(1, 10):
            ds = last + dt.timedelta(days=k)
            if len(vals) < 14:
                p = sum(vals[-7:]) / len(vals[-7:])
            else:
                f = plain_features(vals, ds)
                p = max(library.predict(Vectors.dense([float(f[x]) for x in T.DAILY_FEATURES])), 0.0)
            assert got[user, ds] == pytest.approx((p, p * 0.8, p * 1.2), rel=1e-9)
            vals.append(p)


def test_horizon_is_one_lazy_stage(spark):
    """No job runs for a step: after the series there is a single shuffle."""
    daily = daily_totals(expenses(spark)).cache()
    fc = T.daily_recursion(daily, lambda f: f["lag_1"] * 0.5 + f["lag_14"], periods=30)
    plan = fc._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan and "Python" not in plan
    assert fc.count() == 90


def test_monthly_recursion_equals_the_frame_form(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 11)]
    series = spark.createDataFrame([(d, float(100 + 7 * i % 31)) for i, d in enumerate(months)], "ds date, y double")
    loop = T.monthly_recursive_forecast(series, lambda f: f.withColumn("prediction", F.col("lag_1") * 0.5 + F.col("rolling_6") + F.col("month_num")), 5)
    one = T.monthly_recursion(series, lambda f: f["lag_1"] * 0.5 + f["rolling_6"] + f["month_num"], 5)
    assert sorted(one.collect()) == sorted(loop.collect())
