"""Date texts against pandas; one format for each source."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.date_text import coerce_date_by_source, parse_date, source_formats
from tallyspark.sources.files import import_expenses, reject_report

TEXTS = ["5-Jan-2024", "Jan-05-2024", "2024.01.05", "05.01.2024", "13.01.2024", "01/05/24", "13/05/24", "01-05-24",
         "2024-01-05 10:00 AM", "1/5/2024 10:00 PM", "20240105 10:00", "20240105T101500", "Jan 2024", "January 2024",
         "2024-01", "2024/01", "01/2024", "Friday, January 5, 2024", "Fri 5 Jan 2024", "5 January 2024 10:00",
         "Jan 5 2024 10:00", "Sept 5, 2024", "Sep. 5, 2024", "2024/01/05 10:00:00", "5th Jan 2024", "January 5th, 2024",
         "2024-1-5", "2024 Jan 5", "2024-Jan-05", "05/Jan/2024", "2024", "31-12-2024", "12-31-2024", "mar 3 2024",
         "3 march 24", "May 2024", "2024-01-05T10:00:00.123Z", "2024-01-05 10:00:00+05:30", "2024-01-05T10", "1/5/24 3pm",
         "2024-01-05T10:00:00", "  2024-01-05  ", "20240105", "1/5/2024 9:05", "JAN 5, 2024", "29 February 2024"]
BAD = ["1/5/2024 25:00", "1/5/2024 10:60", "2024-01-05 13:00 PM", "Jan 5", "5", "nan", "", "1704412800", "2024-13-01", "2024-31-01",
       "2024-02-30", "Monday", "2024-W01", "2024-001", "inf", "2024/13/01", "13/13/2024", "0/5/2024", "not a date", "marx 3 2024", "30 February 2024"]


def parsed(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.d for r in df.select("t", parse_date(F.col("t")).alias("d")).collect()}


def test_texts_equal_pandas(spark):
    got = parsed(spark, TEXTS)
    assert got == {t: pd.to_datetime(t).date() for t in TEXTS}


def test_what_pandas_rejects_is_rejected(spark):
    got = parsed(spark, BAD + [None])
    for t in BAD:
        with pytest.raises(Exception):
            assert not pd.isna(pd.to_datetime(t))
        assert got[t] is None, t
    assert got[None] is None
    assert parsed(spark, ["1850-01-05", "2300-01-01"]) == {"1850-01-05": None, "2300-01-01": None}  # a stated rule


def test_random_dates_in_all_orders_equal_pandas(spark):
    rng = random.Random(4)
    formats = ["%Y-%m-%d", "%m/%d/%Y", "%d %B %Y", "%b %d, %Y", "%Y%m%d", "%d-%b-%Y", "%A, %B %d, %Y", "%Y.%m.%d", "%m-%d-%Y",
               "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %I:%M %p", "%d/%m/%Y", "%Y-%m-%dT%H:%M", "%B %Y", "%d.%m.%Y %H:%M"]
    texts = [(dt.datetime(1990, 1, 1) + dt.timedelta(minutes=rng.randrange(30 * 365 * 1440))).strftime(rng.choice(formats)) for _ in range(600)]
    assert parsed(spark, texts) == {t: pd.to_datetime(t).date() for t in texts}


def test_two_digit_years_follow_the_given_year(spark):
    df = spark.createDataFrame([("1/5/70",), ("1/5/99",)], "t string")
    assert [r[0].year for r in df.select(parse_date(F.col("t"), 2024)).collect()] == [2070, 1999]
    assert [r[0].year for r in df.select(parse_date(F.col("t"), 1990)).collect()] == [1970, 1999]


def test_import_takes_them(spark):
    df = spark.createDataFrame([(1, t, "5") for t in TEXTS] + [(2, "Jan 5", "5")], "user_id long, Date string, Amount string")
    good, bad = import_expenses(df, "2024-02-01")
    assert good.count() == len(TEXTS) and [tuple(r) for r in reject_report(bad).collect()] == [(2, "bad_date", 1)]


def test_a_source_has_one_format(spark):
    rows = [("m", t) for t in ("01/02/2024", "01/25/2024", "25/01/2024", "x", None)]        # month first
    rows += [("d", t) for t in ("13/02/2024", "25/01/2024", "01/02/2024", "01/25/2024")]    # day first
    rows += [("i", t) for t in ("2024-01-05", "2024-02-30", "05.01.2024")] + [("t", "05/06/2024"), ("n", "x"), (None, "31.01.2024")]
    df = spark.createDataFrame(rows, "file string, date string")
    assert {r.file: r.format for r in source_formats(df, ["file"]).collect()} == {
        "m": "MM/dd/yyyy", "d": "dd/MM/yyyy", "i": "yyyy-MM-dd", "t": "MM/dd/yyyy", "n": None, None: "dd.MM.yyyy"}
    got = sorted((r.file or "", str(r.date)) for r in coerce_date_by_source(df, ["file"]).collect())
    assert got == sorted([("m", "2024-01-02"), ("m", "2024-01-25"), ("m", "None"), ("m", "None"), ("m", "None"),
                          ("d", "2024-02-13"), ("d", "2024-01-25"), ("d", "2024-02-01"), ("d", "None"),
                          ("i", "2024-01-05"), ("i", "None"), ("i", "None"), ("t", "2024-05-06"), ("n", "None"), ("", "2024-01-31")])
