"""Invariants over the whole test tables."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import clean as C
from tallyspark.operators import forecast as M
from tallyspark.operators import ledger as L
from tallyspark.operators import reports as R
from tallyspark.sources import tables as V
from tallyspark.sources.files import import_expenses


def _sum(df, col):
    return df.agg(F.sum(F.col(col).cast("decimal(38,2)"))).collect()[0][0]


def test_daily_monthly_category_sums_agree(spark, sf):
    e = V.exp_daily(spark, sf)
    a, b, c = (_sum(R.daily_totals(e), "y"), _sum(R.monthly_totals(e), "total"),
               _sum(R.category_summary(e), "total"))
    assert a == b == c


def test_delete_plus_deleted_is_base(spark, sf):
    e = V.exp_daily(spark, sf)
    dels = V.changes(spark, sf).filter("op = 'delete'")
    kept = L.delete_expenses(e, dels)
    gone = e.join(dels.select("id", "user_id"), ["id", "user_id"], "left_semi")
    assert kept.count() + gone.count() == e.count()
    assert kept.join(gone, ["id", "user_id"]).count() == 0


def test_import_good_plus_rejected_is_input(spark, sf):
    up = V.uploads(spark, sf)
    good, bad = import_expenses(up, "2024-02-01")
    assert good.count() + bad.count() == up.count()


def test_clean_chain_is_idempotent_on_its_output(spark, sf):
    df = C.clean_transactions(V.raw_a(spark, sf), V.raw_b(spark, sf))
    again = C.drop_amount_outliers(C.merge_rare_categories(C.drop_invalid_notes(df)))
    assert again.count() == df.count()


def test_forecast_shape_and_bounds(spark, sf):
    fc = M.trailing_mean_forecast(V.exp_daily(spark, sf), periods=7)
    per = fc.groupBy("user_id").count().select(F.min("count"), F.max("count")).collect()[0]
    assert tuple(per) == (7, 7)
    assert fc.filter("yhat < 0 OR yhat_lower > yhat OR yhat > yhat_upper").count() == 0
    st = M.seasonal_trend_forecast(R.daily_totals(V.exp_daily(spark, sf)), 7)
    assert st.filter("yhat < 0 OR yhat_lower < 0 OR yhat_lower > yhat OR yhat > yhat_upper").count() == 0


@pytest.mark.parametrize("name", ["insights", "clean_transactions", "seasonal_trend_forecast",
                                  "tfidf_features", "describe_amount"])
def test_independent_of_shuffle_partitions(spark, sf, name):
    from tallyspark.plans import QUERIES
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_streaming_import_matches_batch(spark, sf):
    from tallyspark.streaming import stream_import
    base = tempfile.mkdtemp(prefix="tally-stream-", dir="/tmp")
    src = os.path.join(base, "in")
    up = V.uploads(spark, sf)
    up.repartition(4).write.option("header", True).csv(src)
    qs = stream_import(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"), "2024-02-01")
    for q in qs:
        q.awaitTermination(120)
    good = spark.read.parquet(os.path.join(base, "out", "expenses"))
    bad = spark.read.parquet(os.path.join(base, "out", "rejected"))
    g, b = import_expenses(up, "2024-02-01")
    assert good.count() == g.count() and bad.count() == b.count()
    assert _sum(good, "amount") == _sum(g, "amount")


def test_streaming_month_spend(spark, sf):
    from tallyspark.streaming import read_month_spend, stream_month_spend
    base = tempfile.mkdtemp(prefix="tally-spend-", dir="/tmp")
    e = V.exp_daily(spark, sf)
    e.write.parquet(os.path.join(base, "exp"))
    for _ in range(2):  # the second run adds one more file to the first one's state
        q = stream_month_spend(spark, os.path.join(base, "exp"), e.schema, os.path.join(base, "spend"),
                               os.path.join(base, "ckpt"))
        q.awaitTermination(120)
        now = read_month_spend(spark, os.path.join(base, "spend"))
        assert _sum(now, "spent") == _sum(spark.read.parquet(os.path.join(base, "exp")), "amount")
        e.limit(100).write.mode("append").parquet(os.path.join(base, "exp"))


def test_import_counts_come_from_the_write(spark, sf):
    from pyspark.sql import Observation
    obs = Observation("import")
    up = V.uploads(spark, sf)
    good, bad = import_expenses(up, "2024-02-01", observation=obs)
    path = tempfile.mkdtemp(prefix="tally-import-", dir="/tmp")
    good.write.mode("overwrite").parquet(path)
    counts = obs.get
    assert counts["imported"] == spark.read.parquet(path).count()
    assert counts["imported"] + counts["rejected"] == up.count()
