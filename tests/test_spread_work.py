"""Work that is large for its input's bytes is dealt to all tasks and done once."""

import datetime as dt
import re

from tallyspark.operators import models
from tallyspark.operators.categorize import token_counts
from tallyspark.operators.forecast import seasonal_trend_regression
from tallyspark.sources.synthetic import synthetic_expenses


def test_regression_makes_the_gram_matrix_once_and_deals_out_users(spark):
    rows = [(u, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for u in range(8) for i in range(12)]
    fc = seasonal_trend_regression(spark.createDataFrame(rows, "user_id long, ds date, y double"), 2)
    assert len(re.findall(r"aggregate\(x#", fc._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert "REPARTITION_BY_NUM" in fc._jdf.queryExecution().executedPlan().toString()


def test_users_of_the_generator_are_dealt_out(spark):
    made = synthetic_expenses(spark.range(3).coalesce(1), "2024-06-30", days=40)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    # one hash a purpose (draws of a day, category, amount, mode)
    assert plan.count("md5(") == 4


def test_terms_of_a_document_are_counted_in_its_row(spark):
    """Also where ids repeat, and without a shuffle of all terms by document."""
    rows = [(1, "aa bb aa c"), (2, "bb"), (2, "bb dd dd"), (3, None), (4, ""), (None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, clean_notes string")
    got = {(r.doc_id, r.token): r.tf for r in token_counts(docs).collect()}
    assert got == {(1, "aa"): 2, (1, "bb"): 1, (2, "bb"): 2, (2, "dd"): 2, (None, "aa"): 1}
    alone = spark.createDataFrame(rows[:2], "doc_id long, clean_notes string")
    plan = token_counts(alone)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("inline(") and plan.count("Aggregate") == 1  # of shared ids only


def test_users_of_the_tree_forecast_and_rows_of_the_fit_are_dealt_out(spark, monkeypatch):
    rows = [(u * 100 + i, u, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for u in range(8) for i in range(30)]
    e = spark.createDataFrame(rows, "id long, user_id long, date date, amount double")
    seen = []

    def fit(train, *a, **k):
        seen.append(train.rdd.getNumPartitions())
        return fitted(train, *a, **k)

    fitted = models.fit_trees
    monkeypatch.setattr(models, "fit_trees", fit)
    monkeypatch.setattr(models, "TASK_ROWS", 40)
    fc = models.boosted_tree_forecast(e, 2, params=dict(maxIter=2, maxDepth=2, seed=1))
    plan = fc._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "MapInArrow" in plan  # a batch of users, not a split of one of them
    assert seen == [min(spark.sparkContext.defaultParallelism, 8 * 16 // 40)] and fc.count() == 16
