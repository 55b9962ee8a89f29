"""Feature tables fed day by day equal the batch tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import feature_state as FS
from tallyspark.operators import series as S

DAY0 = date(2024, 1, 1)


def history(spark, drop=()):
    rows = [(u, DAY0 + timedelta(d), float((u * 7 + d * d) % 13) + 0.25)
            for u in (1, 2, 3) for d in range(24) if (u, d) not in drop and (d * u) % 5 != 4]
    return spark.createDataFrame(rows, "user_id long, ds date, y double")


def batch_table(days, gap_fill):
    if gap_fill:
        d = S.rolling_strict(S.lag_features(S.calendar_features(S.calendar_gap_fill(days))))
        return d.dropna(subset=[f"lag_{k}" for k in S.DAILY_LAGS] + ["rolling_7", "rolling_14"])
    d = S.rolling_partial(S.lag_features(S.calendar_features(days)))
    return d.dropna(subset=[f"lag_{k}" for k in S.DAILY_LAGS])


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("gap_fill", [False, True])
def test_any_batches_give_the_batch_table(spark, gap_fill):
    days = history(spark).cache()
    state, out = FS.empty_state(spark, days), []
    for lo, hi in [(0, 1), (1, 2), (2, 9), (9, 9), (9, 20), (20, 21), (21, 24)]:
        part = days.filter(F.col("ds").between(DAY0 + timedelta(lo), DAY0 + timedelta(hi - 1)))
        step = FS.advance(state, part, gap_fill=gap_fill)
        assert step.late.count() == 0
        out += rows(step.features)
        state = step.state.checkpoint()
    whole = batch_table(days, gap_fill)
    assert sorted(out) == rows(whole) and out
    assert all(r["n"] <= FS.REACH for r in state.selectExpr("size(tail) AS n").collect())


def test_late_days_are_told_and_their_keys_rebuilt(spark):
    days = history(spark)
    first = days.filter(F.col("ds") != F.lit(DAY0 + timedelta(5)))
    state = FS.advance(FS.empty_state(spark, days), first).state.checkpoint()
    late_day = days.filter((F.col("ds") == F.lit(DAY0 + timedelta(5))) & (F.col("user_id") == 2))
    step = FS.advance(state, late_day)
    assert rows(step.late) == rows(late_day) and step.features.count() == 0
    assert rows(FS.open_state(step.state)) == rows(FS.open_state(state))
    known = first.unionByName(late_day)
    again = FS.rebuild(state, known, step.late)
    assert rows(again.features) == rows(batch_table(known.filter("user_id = 2"), False))
    assert rows(FS.open_state(again.state)) == rows(FS.open_state(FS.advance(state.limit(0), known).state))


def test_empty_tables_and_null_keys(spark):
    days = history(spark)
    none = FS.advance(FS.empty_state(spark, days), days.limit(0), gap_fill=True)
    assert none.features.count() == none.state.count() == none.late.count() == 0
    odd = spark.createDataFrame([(None, DAY0, 1.0), (1, None, 1.0)], days.schema)
    assert FS.advance(FS.empty_state(spark, days), odd).state.count() == 0
