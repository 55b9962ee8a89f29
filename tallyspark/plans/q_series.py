"""Series feature queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import feature_state as FS
from ..operators import reports as R
from ..operators import seasonality as SE
from ..operators import series as S
from ..session import materialize
from ..sources.tables import exp_daily, exp_monthly
from .q_reports import heven, msum
from .registry import register

DAILY = f"""d AS (SELECT user_id, date AS ds, {msum('amount')} AS y FROM exp_daily
  WHERE date IS NOT NULL GROUP BY 1, 2)"""
CAL = """CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, CAST(month(ds) AS INTEGER) AS month,
  CAST(day(ds) AS INTEGER) AS day, CAST(quarter(ds) AS INTEGER) AS quarter,
  CAST(dayofyear(ds) AS INTEGER) AS dayofyear, CAST(weekofyear(ds) AS INTEGER) AS weekofyear,
  CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend"""
FILLED = """span AS (SELECT user_id, MIN(ds) AS lo, MAX(ds) AS hi FROM d GROUP BY 1),
grid AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM span),
f AS (SELECT g.user_id, g.ds, COALESCE(d.y, 0.0) AS y FROM grid g LEFT JOIN d USING (user_id, ds))"""
LAGS = ", ".join(f"lag(y, {k}) OVER wo AS lag_{k}" for k in S.DAILY_LAGS)


def mean_over(n: int, win: str = "wo") -> str:
    frame = f"(PARTITION BY user_id ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CAST(SUM(CAST(y AS DECIMAL(28,6))) OVER {frame} AS DOUBLE) / COUNT(y) OVER {frame}")


def strict_over(n: int, keys: str = "user_id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    frame = f"({part}ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN COUNT(y) OVER {frame} = {n} THEN "
            f"CAST(SUM(CAST(y AS DECIMAL(28,6))) OVER {frame} AS DOUBLE) / COUNT(y) OVER {frame} END")


STD7 = heven("COALESCE(stddev_samp(y) OVER (PARTITION BY user_id ORDER BY ds ROWS BETWEEN 6 PRECEDING "
             "AND CURRENT ROW), 0.0)", 6)
WO = "WINDOW wo AS (PARTITION BY user_id ORDER BY ds)"
ED = ("exp_daily",)


def _daily(spark, sf):
    return R.daily_totals(exp_daily(spark, sf))


@register("calendar_features", f"WITH {DAILY} SELECT user_id, ds, y, {CAL} FROM d", ED)
def q_calendar_features(spark, sf):
    return S.calendar_features(_daily(spark, sf))


@register("calendar_gap_fill", f"WITH {DAILY}, {FILLED} SELECT * FROM f", ED)
def q_calendar_gap_fill(spark, sf):
    return S.calendar_gap_fill(_daily(spark, sf))


@register("lag_features", f"WITH {DAILY} SELECT user_id, ds, y, {LAGS} FROM d {WO}", ED)
def q_lag_features(spark, sf):
    return S.lag_features(_daily(spark, sf))


@register("rolling_strict", f"""WITH {DAILY}
SELECT user_id, ds, y, {strict_over(7)} AS rolling_7, {strict_over(14)} AS rolling_14 FROM d""", ED)
def q_rolling_strict(spark, sf):
    return S.rolling_strict(_daily(spark, sf))


@register("rolling_partial", f"""WITH {DAILY}
SELECT user_id, ds, y, {mean_over(7)} AS rolling_mean_7, {mean_over(14)} AS rolling_mean_14,
       {STD7} AS rolling_std_7 FROM d""", ED)
def q_rolling_partial(spark, sf):
    return S.rolling_partial(_daily(spark, sf))


FEATURES_SQL = f"""WITH {DAILY},
x AS (SELECT user_id, ds, y, {CAL}, {LAGS}, {mean_over(7)} AS rolling_mean_7,
             {mean_over(14)} AS rolling_mean_14, {STD7} AS rolling_std_7 FROM d {WO})
SELECT * FROM x WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL
  AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL"""


@register("feature_table_daily", FEATURES_SQL, ED)
def q_feature_table_daily(spark, sf):
    return S.feature_table_daily(exp_daily(spark, sf))


FILLED_FEATURES_SQL = f"""WITH {DAILY}, {FILLED},
x AS (SELECT user_id, ds, y, {CAL}, {LAGS.replace('OVER wo', 'OVER wo')},
             {strict_over(7)} AS rolling_7, {strict_over(14)} AS rolling_14 FROM f {WO})
SELECT * FROM x WHERE lag_14 IS NOT NULL AND lag_7 IS NOT NULL AND lag_3 IS NOT NULL
  AND lag_2 IS NOT NULL AND lag_1 IS NOT NULL AND rolling_7 IS NOT NULL AND rolling_14 IS NOT NULL"""


@register("feature_table_daily_gapfilled", FILLED_FEATURES_SQL, ED)
def q_feature_table_daily_gapfilled(spark, sf):
    return S.feature_table_daily_gapfilled(exp_daily(spark, sf))


# monthly all-user series of the cleaned long history (0 < amount <= cap)
MONTHLY = """ms AS (SELECT date_trunc('month', date) AS ds,
  CAST(SUM(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS y FROM exp_monthly
  WHERE date IS NOT NULL AND amount > 0 AND amount <= 100000.0 GROUP BY 1)"""
EM = ("exp_monthly",)


def monthly(spark, sf):
    return S.monthly_series(C.drop_amount_outliers(exp_monthly(spark, sf)))


MONTHLY_FEATS = f"""mf AS (SELECT * FROM (
  SELECT CAST(ds AS DATE) AS ds, y, CAST(month(ds) AS INTEGER) AS month_num, CAST(year(ds) AS INTEGER) AS year_num,
         CAST(quarter(ds) AS INTEGER) AS quarter,
         lag(y, 1) OVER (ORDER BY ds) AS lag_1, lag(y, 2) OVER (ORDER BY ds) AS lag_2,
         lag(y, 3) OVER (ORDER BY ds) AS lag_3,
         {strict_over(3, '')} AS rolling_3, {strict_over(6, '')} AS rolling_6 FROM ms)
  WHERE lag_3 IS NOT NULL AND rolling_6 IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL
    AND rolling_3 IS NOT NULL)"""


@register("month_start_from_parts", """
SELECT DISTINCT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       make_date(year(date), month(date), 1) AS month_start, CAST(quarter(date) AS INTEGER) AS quarter
FROM exp_monthly WHERE date IS NOT NULL""", EM)
def q_month_start_from_parts(spark, sf):
    e = exp_monthly(spark, sf).filter(F.col("date").isNotNull())
    parts = e.select(F.year("date").alias("year"), F.month("date").alias("month")).distinct()
    return S.month_start_from_parts(parts)


@register("feature_table_monthly", f"WITH {MONTHLY}, {MONTHLY_FEATS} SELECT * FROM mf", EM)
def q_feature_table_monthly(spark, sf):
    return S.feature_table_monthly(monthly(spark, sf))


@register("temporal_holdout", f"""WITH {MONTHLY}, {MONTHLY_FEATS}
SELECT *, CASE WHEN row_number() OVER (ORDER BY ds DESC) <= 6 THEN 'test' ELSE 'train' END AS split
FROM mf""", EM)
def q_temporal_holdout(spark, sf):
    return S.temporal_holdout(S.feature_table_monthly(monthly(spark, sf)), 6)


@register("last_n_history", f"""WITH {DAILY}
SELECT user_id, ds, y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS rn FROM d)
WHERE rn <= 60""", ED)
def q_last_n_history(spark, sf):
    return S.last_n(_daily(spark, sf), 60)


@register("future_calendar", f"""WITH {DAILY}, {MONTHLY},
last AS (SELECT user_id, MAX(ds) AS hi FROM d GROUP BY 1),
lm AS (SELECT MAX(ds) AS hi FROM ms)
SELECT user_id, CAST(unnest(generate_series(hi + 1, hi + 30, INTERVAL 1 DAY)) AS DATE) AS ds, 'day' AS unit FROM last
UNION ALL
SELECT CAST(NULL AS BIGINT), CAST(unnest(generate_series(hi + INTERVAL 1 MONTH, hi + INTERVAL 6 MONTH, INTERVAL 1 MONTH))
       AS DATE), 'month' FROM lm""", ED + EM)
def q_future_calendar(spark, sf):
    """The next days of every user and the next months of the all-user series."""
    days = S.future_days(_daily(spark, sf), 30).select("user_id", "ds", F.lit("day").alias("unit"))
    months = S.future_months(monthly(spark, sf), 6).select(
        F.lit(None).cast("long").alias("user_id"), "ds", F.lit("month").alias("unit"))
    return days.unionByName(months)


@register("month_key", """
SELECT id, user_id, strftime(date, '%Y-%m') AS month FROM exp_monthly""", EM)
def q_month_key(spark, sf):
    from ..functions import month_key
    return exp_monthly(spark, sf).select("id", "user_id", month_key("date").alias("month"))


# --- the feature tables fed in three batches, state written between them ------

CUTS = ("2024-01-11", "2024-01-19")


def _fed(spark, sf, gap_fill: bool):
    days = materialize(_daily(spark, sf), "feature_days")
    lo, hi = (F.to_date(F.lit(c)) for c in CUTS)
    state, features = FS.empty_state(spark, days), []
    for batch in (days.filter(F.col("ds") < lo), days.filter((F.col("ds") >= lo) & (F.col("ds") < hi)),
                  days.filter(F.col("ds") >= hi)):
        step = FS.advance(state, batch, gap_fill=gap_fill)
        features.append(step.features)
        state = materialize(step.state, "feature_state")
    return reduce(lambda a, b: a.unionByName(b), features), state


@register("feature_table_daily_fed", FEATURES_SQL, ED)
def q_feature_table_daily_fed(spark, sf):
    return _fed(spark, sf, False)[0]


@register("feature_table_daily_gapfilled_fed", FILLED_FEATURES_SQL, ED)
def q_feature_table_daily_gapfilled_fed(spark, sf):
    return _fed(spark, sf, True)[0]


@register("feature_state", f"""WITH {DAILY}
SELECT user_id, ds, y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS rn FROM d)
WHERE rn <= 14""", ED)
def q_feature_state(spark, sf):
    return FS.open_state(_fed(spark, sf, False)[1])


# --- seasonal pattern (R2) -----------------------------------------------------

def _strength_sql(key: str, phase: str, period: int) -> str:
    """SQL of ``seasonal_strength`` (two passes) over ``f (key, ds, y)``."""
    h, w = period // 2, f"PARTITION BY {key} ORDER BY ds"
    if period % 2:
        fr = f"({w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
        first = f"CASE WHEN COUNT(y) OVER {fr} = {period} THEN SUM(y) OVER {fr} / {period} END"
    else:
        first = (f"CASE WHEN COUNT(y) OVER ({w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {period + 1} THEN "
                 f"(SUM(y) OVER ({w} ROWS BETWEEN {h} PRECEDING AND {h - 1} FOLLOWING) + "
                 f"SUM(y) OVER ({w} ROWS BETWEEN {h - 1} PRECEDING AND {h} FOLLOWING)) / {2 * period} END")

    def season(src: str, out: str) -> str:
        return f"""{out}p AS (SELECT {key}, phase, AVG(y - trend) AS m FROM {src} GROUP BY 1, 2),
{out}l AS (SELECT {key}, AVG(m) AS level FROM {out}p GROUP BY 1),
{out} AS (SELECT s.*, COALESCE(m - level, 0.0) AS season FROM {src} s JOIN {out}p USING ({key}, phase) JOIN {out}l USING ({key}))"""

    return f"""p0 AS (SELECT {key}, ds, y, CAST({phase} AS INTEGER) AS phase FROM f),
t1 AS (SELECT *, {first} AS trend FROM p0),
{season('t1', 's1')},
t2 AS (SELECT {key}, ds, y, phase, AVG(y - season) OVER ({w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS trend FROM s1),
{season('t2', 's2')},
r AS (SELECT *, {heven('season', 6)} AS sr FROM s2),
g AS (SELECT {key}, COUNT(*) AS n_rows, var_pop(y - trend) AS va, var_pop(y - trend - season) AS vr, AVG(y * y) AS sq,
             MAX(sr) AS hi, MIN(sr) AS lo FROM r GROUP BY 1),
q AS (SELECT g.*, (SELECT MIN(phase) FROM r WHERE r.{key} = g.{key} AND sr = hi) AS hp,
             (SELECT MIN(phase) FROM r WHERE r.{key} = g.{key} AND sr = lo) AS lp,
             n_rows >= {2 * period} AND va > sq * 1e-18 AS ok FROM g)
SELECT {key}, n_rows, CASE WHEN ok THEN {heven('greatest(0.0, 1 - vr / va)', 6)} END AS strength,
  CASE WHEN ok THEN hp END AS peak_phase, CASE WHEN ok THEN hi END AS peak_season,
  CASE WHEN ok THEN lp END AS low_phase, CASE WHEN ok THEN lo END AS low_season FROM q"""


@register("seasonal_strength_weekly", f"WITH {DAILY}, {FILLED}, {_strength_sql('user_id', 'isodow(ds) - 1', 7)}", ED)
def q_seasonal_strength_weekly(spark, sf):
    """The week's pattern of every user (phase 0 is Monday)."""
    return SE.seasonal_strength(S.calendar_gap_fill(_daily(spark, sf)), F.weekday("ds"), 7)


@register("seasonal_strength_yearly", f"""WITH m AS (SELECT category, CAST(date_trunc('month', date) AS DATE) AS ds,
  {msum('amount')} AS y FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1, 2),
span AS (SELECT category, MIN(ds) AS lo, MAX(ds) AS hi FROM m GROUP BY 1),
grid AS (SELECT category, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ds FROM span),
f AS (SELECT g.category, g.ds, COALESCE(m.y, 0.0) AS y FROM grid g LEFT JOIN m USING (category, ds)),
{_strength_sql('category', 'month(ds)', 12)}""", EM)
def q_seasonal_strength_yearly(spark, sf):
    """The year's pattern of every category (phase 1 is January)."""
    series = S.month_gap_fill(S.monthly_series(exp_monthly(spark, sf), ["category"]), ["category"])
    return SE.seasonal_strength(series, F.month("ds"), 12, ["category"])
