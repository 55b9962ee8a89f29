"""Hot keys: one key holding a third of all rows is split, results unchanged."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import clean as C
from tallyspark.operators import ledger as L
from tallyspark.operators import reports as R
from tallyspark.operators import skew


@pytest.fixture()
def low_thresholds(monkeypatch):
    monkeypatch.setattr(skew, "MIN_ROWS", 100)
    monkeypatch.setattr(skew, "TARGET_ROWS", 1000)


def hot_frame(spark, n=30000):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 100).alias("user_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 60).cast("int")).alias("date"),
        F.element_at(F.array(*[F.lit(c) for c in "abcde"]), (F.col("id") % 5 + 1).cast("int")).alias("category"),
        (F.col("id") % 1000 / 10).alias("amount"), F.lit("Cash").alias("payment_mode"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), (F.col("id") % 97).cast("string")))
        .alias("notes"))


def test_every_large_key_is_hot_with_salts_for_its_rows(spark, low_thresholds):
    df = hot_frame(spark)
    counts = df.groupBy("notes").agg(F.count(F.lit(1)).alias("_n"))
    hot = {r.notes: r._salts for r in skew.hot_keys(counts, ["notes"]).collect()}
    assert hot["hot"] == 10 and len(hot) == 98 and set(hot.values()) == {1, 10}


def test_salted_join_equals_plain_join(spark, low_thresholds):
    df = hot_frame(spark)
    table = df.select("notes").distinct().withColumn("tag", F.length("notes"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        cols = df.columns + (["tag"] if how in ("inner", "left") else [])
        a = sorted(map(tuple, skew.salted_join(df, table, ["notes"], how, salt_from=["id"])
                       .select(*cols).collect()))
        b = sorted(map(tuple, df.join(table, ["notes"], how).select(*cols).collect()))
        assert a == b, how


def test_hot_rows_spread_over_sub_keys(spark, low_thresholds):
    df = hot_frame(spark)
    table = df.select("notes").distinct()
    # without a row id the hash of all columns places a row, the same way again
    a, b = (sorted(skew.salted_join(df, table, ["notes"], "inner").select("id").collect()) for _ in range(2))
    assert a == b and len(a) == df.count()
    spread = df.filter("notes = 'hot'").select(F.pmod(F.xxhash64(*df.columns), F.lit(10)).alias("s"))
    assert spread.distinct().count() == 10


def test_operators_unchanged_under_salting(spark, low_thresholds):
    df = hot_frame(spark)
    got = sorted(map(tuple, C.resolve_note_category(df).collect()))
    dom = R.dominant_category(df).select("notes", "dominant_category")
    want = sorted(map(tuple, df.join(dom, "notes", "left")
                      .withColumn("category", F.coalesce("dominant_category", "category"))
                      .select(*df.columns).collect()))
    assert got == want
    users = spark.createDataFrame([(7,), (3,)], "user_id long")
    left = L.purge_user_expenses(df, users)
    assert left.filter("user_id IN (3, 7)").count() == 0
    assert left.count() == df.filter("user_id NOT IN (3, 7)").count()
    h = R.amount_histogram(df).groupBy().sum("n").collect()[0][0]
    assert h == df.count()


def test_thresholds_from_session_conf(spark):
    df = hot_frame(spark)
    counts = df.groupBy("notes").agg(F.count(F.lit(1)).alias("_n"))
    spark.conf.set("tallyspark.skew.minRows", "5000")
    spark.conf.set("tallyspark.skew.targetRows", "3000")
    try:
        hot = skew.hot_keys(counts, ["notes"]).collect()
    finally:
        spark.conf.unset("tallyspark.skew.minRows")
        spark.conf.unset("tallyspark.skew.targetRows")
    assert [(r.notes, r._salts) for r in hot] == [("hot", 4)]
