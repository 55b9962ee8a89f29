"""Hand-made frames for the rules the big tables do not hit (FIXTURES.md §3)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import clean_text, currency_label, half_even
from tallyspark.operators import budget as B
from tallyspark.operators import forecast as M
from tallyspark.operators import ledger as L
from tallyspark.operators import reports as R
from tallyspark.operators import series as S
from tallyspark.operators.quantiles import exact_quantiles
from tallyspark.sources.files import import_expenses

D = dt.date
SCHEMA = "id long, user_id long, date date, category string, amount double, payment_mode string, notes string"


def exp(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_tie_takes_smallest_key(spark):
    e = exp(spark, [(1, 1, D(2024, 1, 1), "b", 10.0, "Cash", "x"),
                    (2, 1, D(2024, 1, 2), "a", 10.0, "Cash", "x")])
    row = R.insights(e).collect()[0]
    assert row.top_category == "a"
    dom = R.dominant_category(e).collect()[0]
    assert dom.dominant_category == "a"


def test_null_dates_and_amounts(spark):
    e = exp(spark, [(1, 1, None, "a", 5.0, "Cash", ""), (2, 1, D(2024, 1, 1), "a", None, "Cash", ""),
                    (3, 1, D(2024, 1, 1), "a", 2.5, "Cash", "")])
    assert [(r.ds, r.y) for r in R.daily_totals(e).collect()] == [(D(2024, 1, 1), 2.5)]
    cs = R.category_summary(e).collect()[0]
    assert cs.n == 2 and cs.total == 7.5


def test_single_day_single_user(spark):
    e = exp(spark, [(1, 1, D(2024, 1, 1), "a", 5.0, "Cash", "")])
    d = R.daily_totals(e)
    rp = S.rolling_partial(d).collect()[0]
    assert rp.rolling_std_7 == 0.0 and rp.rolling_mean_7 == 5.0
    assert S.rolling_strict(d).collect()[0].rolling_7 is None
    assert R.month_growth(e).collect()[0].growth_pct == 0.0


def test_first_of_month_counts_in_that_month(spark):
    e = exp(spark, [(1, 1, D(2024, 3, 1), "a", 7.0, "Cash", ""),
                    (2, 1, D(2024, 2, 1), "a", 3.0, "Cash", "")])
    r = R.month_over_month(e, "2024-03-15").collect()[0]
    assert (r.this_month, r.last_month) == (7.0, 3.0)
    assert abs(r.mom_change_pct - (7 - 3) / 3 * 100) < 1e-12


def test_budget_zero_limit_and_exact_limit(spark):
    e = exp(spark, [(1, 1, D(2024, 1, 5), "food", 100.0, "Cash", ""),
                    (2, 2, D(2024, 1, 5), "food", 50.0, "Cash", "")])
    b = spark.createDataFrame([(1, "2024-01", "food", 0.0), (2, "2024-01", "food", 50.0),
                               (2, "2024-01", "Overall", 50.0)],
                              "user_id long, month string, category string, budget_amount double")
    al = {(r.user_id, r.category): r for r in B.budget_alerts(b, e).collect()}
    assert al[(1, "food")].pct is None and al[(1, "food")].alert == "Over Budget"
    assert al[(2, "food")].alert == "Over Budget" and al[(2, "food")].pct == 100.0
    ov = B.budget_overall(b, e).collect()[0]
    assert ov.over_budget and ov.over_by == 0.0 and ov.remaining is None
    cat = {r.user_id: r for r in B.budget_by_category(b, e).collect()}
    assert cat[2].remaining == 0.0 and not cat[2].over_budget
    assert cat[1].pct == 0.0  # limit 0 -> capped percent 0


def test_history_guard_14_vs_15_rows(spark):
    rows = [(i, 1, D(2024, 1, 1) + dt.timedelta(days=i), "a", float(i + 1), "Cash", "") for i in range(14)]
    rows += [(100 + i, 2, D(2024, 1, 1) + dt.timedelta(days=i), "a", float(i + 1), "Cash", "")
             for i in range(15)]
    e = exp(spark, rows)
    ok, skipped = M.eligible(R.daily_totals(e), 15)
    assert [r.user_id for r in skipped.collect()] == [1]
    ft = S.feature_table_daily(e).groupBy("user_id").count().collect()
    assert [(r.user_id, r["count"]) for r in ft] == [(2, 1)]


def test_iso_week_merges_years_and_calendar(spark):
    e = exp(spark, [(1, 1, D(2023, 1, 2), "a", 1.0, "Cash", ""),
                    (2, 1, D(2024, 1, 1), "a", 2.0, "Cash", "")])
    rows = R.weekly_heatmap(e).collect()
    assert len(rows) == 1 and rows[0].week == 1 and rows[0].mon == 3.0
    c = S.calendar_features(spark.createDataFrame([(D(2024, 12, 30),), (D(2024, 12, 28),)], "ds date"))
    got = {r.ds: r for r in c.collect()}
    assert got[D(2024, 12, 30)].weekofyear == 1 and got[D(2024, 12, 30)].dayofweek == 0
    assert got[D(2024, 12, 28)].dayofweek == 5 and got[D(2024, 12, 28)].is_weekend == 1


def test_half_even_matches_numpy(spark):
    vals = [0.125, 40.855, 0.375, 2.675, 1.005, 123.4550000001]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(half_even("x")).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_patches_and_upserts(spark):
    base = exp(spark, [(1, 1, D(2024, 1, 1), "a", 5.0, "Cash", "n")])
    p = spark.createDataFrame(
        [(1, 1, None, None, None, None, None, 1), (9, 2, None, None, 3.0, None, None, 1)],
        "id long, user_id long, date date, category string, amount double, payment_mode string, "
        "notes string, seq int")
    assert L.apply_expense_updates(base, p).collect()[0].amount == 5.0
    p2 = spark.createDataFrame(
        [(1, 1, None, None, 6.0, None, None, 1), (1, 1, None, None, 7.0, None, None, 2)], p.schema)
    assert L.apply_expense_updates(base, p2).collect()[0].amount == 7.0
    # a patch for another owner's id changes nothing
    p3 = spark.createDataFrame([(1, 2, None, None, 8.0, None, None, 1)], p.schema)
    assert L.apply_expense_updates(base, p3).collect()[0].amount == 5.0
    b = spark.createDataFrame([(1, "2024-01", "a", 10.0)],
                              "user_id long, month string, category string, budget_amount double")
    inc = spark.createDataFrame([(1, "2024-01", "a", 20.0, 1), (1, "2024-01", "a", 30.0, 2),
                                 (1, "2024-02", "a", 5.0, 1)],
                                "user_id long, month string, category string, budget_amount double, seq int")
    once = L.upsert_budgets(b, inc)
    twice = L.upsert_budgets(once, inc)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {(r.month, r.budget_amount) for r in once.collect()} == {("2024-01", 30.0), ("2024-02", 5.0)}


def test_import_missing_columns_and_bad_rows(spark):
    up = spark.createDataFrame([(1, "2024-01-05", "12.5"), (1, "bad", "3"), (1, "2024-01-06", "x"),
                                (1, "06/01/2024", None)],
                               "user_id long, date string, Amount string")
    good, bad = import_expenses(up, as_of="2024-02-01")
    g = good.collect()
    assert len(g) == 1 and g[0].category == "Other" and g[0].payment_mode == "Cash" and g[0].notes == ""
    assert g[0].amount == 12.5 and g[0].date == D(2024, 1, 5)
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["bad_amount", "bad_amount", "bad_date"]
    # missing date column -> as_of
    up2 = spark.createDataFrame([(1, "4")], "user_id long, amount string")
    assert import_expenses(up2, as_of="2024-02-01")[0].collect()[0].date == D(2024, 2, 1)


def test_clean_text_and_labels(spark):
    df = spark.createDataFrame([("  Hello,   World!!  ",), ("Ümlaut café 42",)], "s string")
    assert [r[0] for r in df.select(clean_text("s")).collect()] == ["hello world", "mlaut caf 42"]
    n = spark.createDataFrame([(150000.0,), (2500.0,), (999.4,), (123456789.0,)], "x double")
    assert [r[0] for r in n.select(currency_label("x", "")).collect()] == ["1.5L", "2.5K", "999", "1234.6L"]
    assert n.select(currency_label("x")).first()[0] == "₹1.5L"


def test_weekday_means_all_seven(spark):
    e = exp(spark, [(1, 1, D(2024, 1, 1), "a", 4.0, "Cash", ""), (2, 1, D(2024, 1, 8), "a", 2.0, "Cash", "")])
    rows = sorted(R.weekday_means(e).collect(), key=lambda r: r.weekday)
    assert [r.weekday for r in rows] == list(range(7))
    assert rows[0].mean_amount == 3.0 and all(r.mean_amount is None for r in rows[1:])


def test_histogram_edges(spark):
    e = exp(spark, [(i, 1, D(2024, 1, 1), "a", float(v), "Cash", "") for i, v in enumerate([0, 15, 30])]
            + [(9, 2, D(2024, 1, 1), "a", 7.0, "Cash", "")])
    h = {(r.user_id, r.bin): r.n for r in R.amount_histogram(e).collect()}
    assert h == {(1, 1): 1, (1, 16): 1, (1, 30): 1, (2, 1): 1}


def test_exact_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(100, 30, 4000).round(2), np.full(2000, 55.5)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = exact_quantiles(df, "x", [0.25, 0.5, 0.75], buckets=16).collect()[0]
    want = np.quantile(x, [0.25, 0.5, 0.75])
    assert [got.q25, got.q50, got.q75] == pytest.approx(list(want), abs=1e-9)


def test_trailing_mean_equals_python_loop(spark):
    vals = [3.0, 0.0, 5.5, 1.25, 8.0, 2.0, 0.0, 4.0, 9.0, 1.0, 6.0]
    days = [0, 1, 2, 3, 4, 5, 6, 11, 12, 13, 14]  # days 7-10 missing -> gap-filled with 0
    e = exp(spark, [(i, 1, D(2024, 1, 1) + dt.timedelta(days=d), "a", v, "Cash", "")
                    for i, (d, v) in enumerate(zip(days, vals))])
    fc = sorted(M.trailing_mean_forecast(e, periods=5).collect(), key=lambda r: r.ds)
    series = [3.0, 0.0, 5.5, 1.25, 8.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0, 9.0, 1.0, 6.0]
    want = []
    for _ in range(5):
        s = 0.0
        for v in series[-7:]:
            s += v
        series.append(s / 7)
        want.append(series[-1])
    assert [r.yhat for r in fc] == want
    assert fc[0].ds == D(2024, 1, 16)
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in fc)


def test_iso_year_option_keeps_years_apart(spark):
    e = exp(spark, [(1, 1, D(2023, 1, 2), "a", 1.0, "Cash", ""),
                    (2, 1, D(2024, 1, 1), "a", 2.0, "Cash", ""),
                    (3, 1, D(2024, 12, 30), "a", 4.0, "Cash", "")])
    rows = {(r.iso_year, r.week): r.mon for r in R.weekly_heatmap(e, iso_year=True).collect()}
    assert rows == {(2023, 1): 1.0, (2024, 1): 2.0, (2025, 1): 4.0}


def test_expense_only_drops_income(spark, sf):
    from tallyspark.operators import clean as C
    from tallyspark.sources import tables as V
    a, b = V.raw_a(spark, sf), V.raw_b(spark, sf)
    allrows = C.clean_transactions(a, b)
    exp_only = C.clean_transactions(a, b, expense_only=True)
    assert exp_only.filter("transaction_type <> 'Expense'").count() == 0
    assert 0 < exp_only.count() < allrows.count()


def test_ratio_band(spark):
    from tallyspark.functions import ratio_band
    df = spark.createDataFrame([(10.0, 100.0), (60.0, 100.0), (90.0, 100.0), (5.0, 0.0)], "v double, m double")
    assert [r[0] for r in df.select(ratio_band("v", "m")).collect()] == ["ok", "warn", "over", "ok"]
    assert [r[0] for r in df.select(ratio_band("v", "m", reverse=True)).collect()] == ["over", "ok", "ok", "over"]


def test_small_amounts_and_one_huge_one(spark):
    rows = [(i, 1, D(2024, 1, 1), "a", 0.004, "Cash", "") for i in range(1000)]
    rows += [(5000, 2, D(2024, 1, 1), "a", 1e30, "Cash", ""), (5001, 2, D(2024, 1, 1), "a", 1.0, "Cash", ""),
             (5002, 3, D(2024, 1, 1), "a", None, "Cash", "")]
    e = exp(spark, rows)
    got = {r.user_id: r.y for r in R.daily_totals(e).collect()}
    assert got == {1: 4.0, 2: 1e30, 3: 0.0}
    assert R.insights(e).count() == 3 and R.monthly_totals(e).filter("total IS NULL").count() == 0


def test_zero_totals_do_not_fail_others(spark):
    e = exp(spark, [(1, 1, D(2024, 1, 1), "a", 0.0, "Cash", ""), (2, 2, D(2024, 1, 1), "a", 2.0, "Cash", "")])
    assert {r.user_id: r.share_pct for r in R.category_analysis(e).collect()} == {1: None, 2: 100.0}
    assert {r.user_id: r.share_pct for r in R.category_breakdown(e).collect()} == {1: None, 2: 100.0}


def test_metrics_of_constant_and_single_rows(spark):
    from tallyspark.operators.evaluate import regression_metrics
    df = spark.createDataFrame([("c", 5.0, 5.0), ("c", 5.0, 5.0), ("d", 5.0, 4.0), ("d", 5.0, 5.0), ("s", 1.0, 1.0),
                                ("v", 1.0, 1.5), ("v", 3.0, 2.5)], "k string, actual double, predicted double")
    got = {r.k: r.r2 for r in regression_metrics(df, keys=["k"]).collect()}
    assert got == {"c": 1.0, "d": 0.0, "s": None, "v": 0.75}


def test_partial_patches_add_up(spark):
    base = exp(spark, [(1, 1, D(2024, 1, 1), "a", 5.0, "Cash", "n")])
    schema = ("id long, user_id long, date date, category string, amount double, payment_mode string, "
              "notes string, seq int")
    p = spark.createDataFrame([(1, 1, None, None, 9.0, None, None, 1), (1, 1, None, None, None, "UPI", None, 2)], schema)
    r = L.apply_expense_updates(base, p).first()
    assert (r.amount, r.payment_mode, r.category) == (9.0, "UPI", "a")
    o = L.apply_expense_updates(base, p, overwrite=True).first()
    assert (o.amount, o.payment_mode, o.category) == (None, "UPI", None)
    other = p.withColumn("user_id", F.lit(2).cast("long"))
    assert L.apply_expense_updates(base, other).first().amount == 5.0
    assert L.apply_expense_updates(base, other, key=["id"]).first().amount == 9.0
    assert L.delete_expenses(base, other).count() == 1
    assert L.delete_expenses(base, other, key=["id"]).count() == 0


def test_orphans_and_recurring(spark):
    e = exp(spark, [(i, 1, D(2024, m, 5), "rent", 10.0, "Cash", "x") for i, m in enumerate((1, 2, 3))]
            + [(9, 77, D(2024, 1, 1), "a", 1.0, "Cash", "")])
    users = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.id for r in L.check_orphans(e, users).collect()] == [9]
    from tallyspark.operators.recurring import recurring_expenses
    got = recurring_expenses(e).collect()
    assert [(r.user_id, r.category, r.occurrences, r.avg_amount) for r in got] == [(1, "rent", 3, 10.0)]


def test_import_dates_and_numbers(spark):
    texts = ["2024-01-05 10:00:00", "2024/01/05", "Jan 5, 2024", "05/01/2024", "25/01/2024", "2024-01-05T10:00:00Z",
             "2024-01-05", "20240105", "5 January 2024", "9999-12-31", "31/31/2024", "", "2024-13-01"]
    up = spark.createDataFrame([(1, t, "1") for t in texts], "user_id long, Date string, Amount string")
    good, bad = import_expenses(up, "2024-02-01")
    jan5 = D(2024, 1, 5)
    assert [r.date for r in good.collect()] == [jan5, jan5, jan5, D(2024, 5, 1), D(2024, 1, 25), jan5, jan5, jan5, jan5]
    assert bad.count() == 4
    num = spark.createDataFrame([(1, "2024-01-05", t) for t in ["12d", "1f", "0x1", " 3 ", "-.5", "1e2", "1,5", ""]],
                                up.schema)
    assert [r.amount for r in import_expenses(num, "2024-02-01")[0].collect()] == [3.0, -0.5, 100.0]


def test_csv_round_trip_of_quotes_and_line_breaks(spark, tmp_path):
    from tallyspark.sources.files import csv_reader, export_expenses_csv, read_transactions_csv, write_csv
    notes = ['say "hi", ok', "two\nlines", "  spaced ", None, "plain", "back\\slash", 'a "" b']
    e = exp(spark, [(i, i % 3, D(2024, 1, 1), "a", 1.5, "Cash", n) for i, n in enumerate(notes)])
    back = csv_reader(spark).schema(e.schema).csv(export_expenses_csv(e, str(tmp_path / "x"), buckets=2))
    assert sorted(back.select(*e.columns).collect()) == sorted(e.collect())
    assert len(list((tmp_path / "x").glob("bucket=*"))) <= 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "f.csv").write_text('date,notes\n2024-01-01,"say ""hi"", ok"\n2024-01-02,"two\nlines"\n')
    got = read_transactions_csv(spark, str(tmp_path / "p"), ["date", "notes"]).collect()
    assert [tuple(r) for r in got] == [("2024-01-01", 'say "hi", ok'), ("2024-01-02", "two\nlines")]
    assert write_csv(e, str(tmp_path / "w"))


def test_forecast_guards(spark):
    def user(u, days):
        return [(u * 100 + i, u, D(2024, 1, 1) + dt.timedelta(days=d), "a", 1.0, "Cash", "") for i, d in enumerate(days)]
    e = exp(spark, user(1, range(12)) + user(2, range(14)) + user(3, range(15)) + user(4, [*range(9), 30])
            + user(5, range(4)))
    page = M.forecast_dispatch(e, "trees", 2, path="page")
    assert {r.user_id: r.reason for r in page[1].collect()} == {
        1: "fewer than 15 calendar days", 2: "fewer than 15 calendar days", 5: "fewer than 10 data points"}
    assert {r.user_id for r in page[0].collect()} == {3, 4}
    assert {r.user_id for r in M.dispatch_guard(e, "trees")[1].collect()} == {1, 2, 4, 5}
    fc, skipped = M.forecast_dispatch(e, "seasonal", 2, path="page")
    assert [r.user_id for r in skipped.collect()] == [5] and {r.user_id for r in fc.collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        M.forecast_dispatch(e, "other")


def test_label_digits_as_python(spark):
    n = spark.createDataFrame([(1150.0,), (115000.0,), (1250.0,), (999.5,)], "x double")
    assert [r[0] for r in n.select(currency_label("x", "")).collect()] == ["1.1K", "1.1L", "1.2K", "1,000"]
