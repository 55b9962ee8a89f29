"""Model sanity: trees learn a weekly pattern; the classifier beats the
majority class; the horizon loop emits exactly ``periods`` rows per user."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import categorize as K
from tallyspark.operators import models as T
from tallyspark.operators.evaluate import classification_report
from tallyspark.operators.tree_columns import TreeColumns
from tallyspark.sources.tables import note_labels


def test_trees_beat_the_mean_on_a_weekly_pattern(spark):
    rows = []
    for u in range(3):
        for i in range(70):
            d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
            rows.append((u * 1000 + i, u, d, "a", 100.0 if d.weekday() >= 5 else 10.0, "Cash", ""))
    e = spark.createDataFrame(rows, "id long, user_id long, date date, category string, "
                                    "amount double, payment_mode string, notes string")
    fc = T.boosted_tree_forecast(e, periods=7, params=dict(maxIter=20, maxDepth=3, stepSize=0.3, seed=1))
    assert fc.groupBy("user_id").count().filter("count != 7").count() == 0
    got = fc.withColumn("truth", F.when(F.weekday("ds") >= 5, 100.0).otherwise(10.0))
    err = got.agg(F.avg(F.abs(F.col("yhat") - F.col("truth")))).collect()[0][0]
    mean_err = got.agg(F.avg(F.abs(F.lit(100 * 2 / 7 + 10 * 5 / 7) - F.col("truth")))).collect()[0][0]
    assert err < mean_err


def test_classifier_beats_majority(spark, sf):
    d = K.train_test_split(K.keep_frequent_categories(note_labels(spark, sf)),
                           key=("clean_notes", "doc_id"))
    model = K.train_category_model(d.filter("split = 'train'"), max_iter=100)
    test = d.filter("split = 'test'")
    pred = K.predict_category(model, test)
    rep = {r.row: r for r in classification_report(
        pred.select(F.col("category").alias("label"), F.col("predicted_category").alias("prediction"))
    ).collect()}
    majority = test.groupBy("category").count().agg(F.max("count")).collect()[0][0] / test.count()
    assert rep["accuracy"].precision > majority
    assert pred.filter("confidence < 0 OR confidence > 1").count() == 0


def test_seasonal_regression_learns_a_weekly_pattern(spark):
    from tallyspark.operators.forecast import seasonal_trend_regression
    rows = []
    for u in range(2):
        for i in range(84):
            d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
            rows.append((u, d, 100.0 + (50.0 if d.weekday() >= 5 else 0.0) + i * 0.5))
    s = spark.createDataFrame(rows, "user_id long, ds date, y double")
    fc = seasonal_trend_regression(s, periods=14).collect()
    assert len(fc) == 28
    for r in fc:
        truth = 100.0 + (50.0 if r.ds.weekday() >= 5 else 0.0) + (r.ds - dt.date(2024, 1, 1)).days * 0.5
        assert abs(r.yhat - truth) < 5.0
        assert 0 <= r.yhat_lower <= r.yhat <= r.yhat_upper


def test_short_users_get_trailing_means(spark):
    """Users whose lags are incomplete stay in the result."""
    rows = []
    for u, days in ((0, 40), (1, 13), (2, 10)):
        for i in range(days):
            y = None if (u, i) == (0, 5) else float(i % 5 + 1)
            rows.append((u * 1000 + i, u, dt.date(2024, 1, 1) + dt.timedelta(days=i), "a", y, "Cash", ""))
    e = spark.createDataFrame(rows, "id long, user_id long, date date, category string, "
                                    "amount double, payment_mode string, notes string")
    fc = T.boosted_tree_forecast(e, periods=3, params=dict(maxIter=3, maxDepth=2, seed=1), min_history=10)
    got = {(r.user_id, r.ds): r.yhat for r in fc.collect()}
    assert len(got) == 9 and all(v is not None for v in got.values())
    assert got[2, dt.date(2024, 1, 11)] == sum(i % 5 + 1 for i in range(3, 10)) / 7
    only = T.boosted_tree_forecast(e.filter("user_id = 2"), periods=2, min_history=10)
    assert only.count() == 2


def test_vocabulary_has_room_for_all_and_models_reload(spark, tmp_path):
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(5)) + (" red" if i % 2 else " blue"), "r" if i % 2 else "b")
            for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, clean_notes string, category string")
    model = K.train_category_model(df, max_iter=5)
    assert len(model.stages[1].vocabulary) == 60 * 5 + 2
    path = T.save_model(model, str(tmp_path / "m"))
    a, b = (sorted(K.predict_category(m, df).select("doc_id", "predicted_category", "confidence").collect())
            for m in (model, T.load_model(path)))
    assert a == b and {r.predicted_category for r in a} <= {"r", "b"}


def test_trees_give_a_batch_of_users_the_days_of_the_column_form(spark):
    """Also to users whose lags are incomplete or whose values are missing."""
    rows = []
    for u, days in enumerate([40, 14, 13, 5, 1, 33, 20]):
        for i in range(days):
            y = None if (u, i) in ((5, 30), (6, 15), (2, 12)) else float((i * 37 + u * 11) % 23) + 0.1 * u
            rows.append((u if u else None, dt.date(2024, 1, 1) + dt.timedelta(days=i * (1 + u % 3)), y))
    daily = spark.createDataFrame(rows, "user_id long, ds date, y double")
    for depth in (0, 1, 3):
        heap = (1 << depth) - 1
        trees = TreeColumns(5, depth, [(k * 7) % 15 for k in range(5 * heap)], [float(k * 5 % 19) for k in range(5 * heap)],
                            [k * 0.37 - 2 for k in range(5 << depth)])
        by_column = T.daily_recursion(
            daily, lambda f: trees.predict(F.array(*[f[x].cast("double") for x in T.DAILY_FEATURES])), 20)
        got, want = (sorted(fc.collect(), key=str) for fc in (T.daily_recursion(daily, trees, 20), by_column))
        assert len(got) == 7 * 20 and got == want
