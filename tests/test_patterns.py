"""Recurring payments with missed and shifted dates; planted seasons."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.recurring import recurring_patterns
from tallyspark.operators.seasonality import decompose, seasonal_strength

COLS = "user_id long, category string, notes string, date date, amount double"


def months(day, skip=()):
    return [date(2023 + m // 12, m % 12 + 1, day) for m in range(14) if m not in skip]


def found(spark, **groups):
    rows = [(1, "Bills", note, d, 10.0) for note, ds in groups.items() for d in ds]
    out = recurring_patterns(spark.createDataFrame(rows, COLS))
    return {r["note"]: r for r in out.collect()}


def test_periods_misses_and_shifts(spark):
    d0 = date(2023, 1, 2)
    got = found(
        spark, rent=months(5), missed=months(5, skip=(6,)),
        shifted=[d + timedelta(4 if d.month == 4 and d.year == 2023 else 0) for d in months(5)],
        gym=[d0 + timedelta(7 * i) for i in range(9)], pay=[d0 + timedelta(14 * i) for i in range(9)],
        tax=[date(y, 4, 1) for y in (2019, 2020, 2021, 2022)], dues=[date(2022 + i // 4, 3 * (i % 4) + 1, 1) for i in range(7)],
        coffee=[d0 + timedelta(i) for i in range(60)], twice=months(5)[:2], once=months(5)[:1],
        odd=[d0 + timedelta(k) for k in (0, 3, 40, 41, 47, 100, 171)])
    assert {k: r["period"] for k, r in got.items()} == {
        "rent": "monthly", "missed": "monthly", "shifted": "monthly", "gym": "weekly", "pay": "fortnightly",
        "tax": "yearly", "dues": "quarterly"}
    assert got["rent"]["score"] == 1.0 and got["rent"]["n_on_time"] == 13
    assert got["missed"]["n_missed"] == 1 and 0.6 < got["missed"]["score"] < 1
    assert got["shifted"]["n_shifted"] == 2 and got["shifted"]["n_missed"] == 0
    assert got["rent"]["next_date"] == date(2024, 3, 5) and got["tax"]["next_date"] == date(2023, 4, 1)
    assert got["gym"]["next_date"] == d0 + timedelta(63)


def test_repeats_nulls_and_no_rows(spark):
    rows = [(1, None, None, d, None if i else 2.0) for i, d in enumerate(months(5)[:4]) for _ in range(3)] + [
        (1, None, None, None, 1.0)]
    df = spark.createDataFrame(rows, COLS)
    r = recurring_patterns(df).collect()
    assert len(r) == 1 and (r[0]["note"], r[0]["n_dates"], r[0]["occurrences"]) == ("", 4, 12)
    assert recurring_patterns(df.limit(0)).count() == 0


def days(spark, fn, n, key="u"):
    return spark.createDataFrame([(key, date(2024, 1, 1) + timedelta(i), float(fn(i))) for i in range(n)],
                                 "user_id string, ds date, y double")


PLANTED = [0.0, 5.0, -3.0, 1.0, 9.0, -8.0, -4.0]


@pytest.mark.parametrize("passes", [1, 2])
def test_a_planted_week_is_recovered(spark, passes):
    s = days(spark, lambda i: 100 + 0.5 * i + PLANTED[i % 7], 70)
    inner = decompose(s, F.weekday("ds"), 7, passes=passes).collect()
    # at the ends the second pass's shrinking average is off by the trend's slope
    assert all(abs(r["season"] - PLANTED[r["phase"]]) < 0.1 for r in inner)
    r = seasonal_strength(s, F.weekday("ds"), 7, passes=passes).collect()[0]
    assert (r["peak_phase"], r["low_phase"], r["n_rows"]) == (4, 5, 70) and r["strength"] > 0.97


def test_noise_constants_and_short_series(spark):
    noise = days(spark, lambda i: (i * 7919 + i * i * 104729) % 1009, 210, "noise")
    flat = days(spark, lambda i: 3.3, 40, "flat")
    short = days(spark, lambda i: PLANTED[i % 7], 13, "short")
    got = {r["user_id"]: r for r in seasonal_strength(noise.union(flat).union(short), F.weekday("ds"), 7).collect()}
    assert got["noise"]["strength"] < 0.3
    assert got["flat"]["strength"] is None and got["flat"]["peak_phase"] is None
    assert got["short"]["strength"] is None and got["short"]["n_rows"] == 13
    assert seasonal_strength(noise.limit(0), F.weekday("ds"), 7).count() == 0


def test_an_even_period(spark):
    s = spark.createDataFrame([(1, date(2015 + i // 12, i % 12 + 1, 1), 50.0 + i + (20.0 if i % 12 == 11 else 0.0))
                               for i in range(60)], "user_id long, ds date, y double")
    r = seasonal_strength(s, F.month("ds"), 12).collect()[0]
    assert r["peak_phase"] == 12 and r["strength"] > 0.9
