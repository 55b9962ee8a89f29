"""Forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as M
from ..operators import reports as R
from ..operators import series as S
from ..functions import half_even
from ..schema import INTERVAL_Z80, MIN_HISTORY
from ..sources.tables import exp_daily, exp_monthly
from .q_reports import heven, msum, pyround
from .q_series import DAILY, MONTHLY, monthly
from .registry import register

ED, EM = ("exp_daily",), ("exp_monthly",)
Z = repr(INTERVAL_Z80)

# --- M2 trailing mean: recursive CTE over a 7-value state ------------------

M2_SQL = f"""WITH RECURSIVE {DAILY},
elig AS (SELECT user_id FROM d GROUP BY 1 HAVING COUNT(*) >= 10
         AND date_diff('day', MIN(ds), MAX(ds)) + 1 >= 15),
d2 AS (SELECT d.* FROM d WHERE user_id IN (SELECT user_id FROM elig)),
span AS (SELECT user_id, MIN(ds) AS lo, MAX(ds) AS hi FROM d2 GROUP BY 1),
grid AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM span),
f AS (SELECT g.user_id, g.ds, COALESCE(d2.y, 0.0) AS y FROM grid g LEFT JOIN d2 USING (user_id, ds)),
seed AS (SELECT user_id, MAX(ds) AS last_ds, list(y ORDER BY ds) AS vals FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS rn FROM f) WHERE rn <= 7
         GROUP BY 1),
rec AS (SELECT user_id, 0 AS step, last_ds AS ds, vals, CAST(NULL AS DOUBLE) AS yhat FROM seed
        UNION ALL
        SELECT user_id, step + 1, ds + 1, list_append(vals[2:], nv), nv FROM (
          SELECT *, ((((((vals[1] + vals[2]) + vals[3]) + vals[4]) + vals[5]) + vals[6]) + vals[7]) / 7 AS nv
          FROM rec) WHERE step < 30),
fc AS (SELECT user_id, CAST(ds AS DATE) AS ds, yhat, yhat * 0.8 AS yhat_lower, yhat * 1.2 AS yhat_upper
       FROM rec WHERE step > 0)"""


def m2(spark, sf):
    return M.trailing_mean_forecast(exp_daily(spark, sf), 30)


@register("trailing_mean_forecast", M2_SQL + " SELECT * FROM fc", ED)
def q_trailing_mean_forecast(spark, sf):
    return m2(spark, sf)


@register("forecast_summary", M2_SQL + f""",
pk AS (SELECT user_id, ds AS peak_day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY yhat DESC, ds) AS r FROM fc) WHERE r = 1),
lw AS (SELECT user_id, ds AS low_day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY yhat ASC, ds) AS r FROM fc) WHERE r = 1),
g AS (SELECT user_id, SUM(yhat) AS s, AVG(yhat) AS a,
             MAX(yhat) AS peak_yhat, MIN(yhat) AS low_yhat FROM fc GROUP BY 1)
SELECT g.user_id, {pyround('s')} AS total_predicted, {pyround('a')} AS avg_daily, peak_day, peak_yhat, low_day, low_yhat
FROM g JOIN pk USING (user_id) JOIN lw USING (user_id)""", ED)
def q_forecast_summary(spark, sf):
    return M.forecast_summary(m2(spark, sf))


@register("forecast_trend", M2_SQL + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds) AS a,
             row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS dd FROM fc),
g AS (SELECT user_id, COUNT(*) AS n, AVG(CASE WHEN a <= 7 THEN yhat END) AS fw,
             AVG(CASE WHEN dd <= 7 THEN yhat END) AS lw FROM r GROUP BY 1)
SELECT user_id, {heven('fw', 4)} AS first_week, {heven('lw', 4)} AS last_week,
       {heven('CASE WHEN fw > 0 THEN (lw - fw) / fw * 100 ELSE 0.0 END', 4)} AS trend_pct
FROM g WHERE n > 7""", ED)
def q_forecast_trend(spark, sf):
    return M.forecast_trend(m2(spark, sf))


@register("forecast_table", M2_SQL + """
SELECT user_id, ds, dayname(ds) AS day, yhat, yhat_lower, yhat_upper FROM fc""", ED)
def q_forecast_table(spark, sf):
    return M.forecast_table(m2(spark, sf))


@register("history_plus_forecast", M2_SQL + """,
h AS (SELECT user_id, ds, y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS r FROM d) WHERE r <= 60)
SELECT user_id, ds, 'history' AS kind, y AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM h
UNION ALL
SELECT user_id, ds, 'forecast', yhat, yhat_lower, yhat_upper FROM fc""", ED)
def q_history_plus_forecast(spark, sf):
    return M.history_plus_forecast(exp_daily(spark, sf), m2(spark, sf))


@register("forecast_dispatch", f"""WITH {DAILY.replace('exp_daily', 'exp_monthly')},
c AS (SELECT user_id, COUNT(*) AS n, date_diff('day', MIN(ds), MAX(ds)) + 1 AS days FROM d GROUP BY 1)
SELECT user_id, n AS n_points, 'fewer than 5 data points' AS reason, 'seasonal' AS model, 'page' AS path
FROM c WHERE n < 5
UNION ALL SELECT user_id, n, CASE WHEN n < 10 THEN 'fewer than 10 data points' ELSE 'fewer than 15 calendar days' END,
  'trees', 'page' FROM c WHERE n < 10 OR days < 15
UNION ALL SELECT user_id, n, 'fewer than 10 data points', 'seasonal', 'service' FROM c WHERE n < 10
UNION ALL SELECT user_id, n, 'fewer than 15 data points', 'trees', 'service' FROM c WHERE n < 15""", EM)
def q_forecast_dispatch(spark, sf):
    """Users that each model refuses, on the page's and the service's path
    (the service's trees by their guard alone: the fit is M3's query)."""
    e = exp_monthly(spark, sf)
    skipped = [M.forecast_dispatch(e, model, path=path)[1]
               for model, path in (("seasonal", "page"), ("trees", "page"), ("seasonal", "service"))]
    skipped.append(M.dispatch_guard(e, "trees", "service")[1])
    return skipped[0].unionByName(skipped[1]).unionByName(skipped[2]).unionByName(skipped[3])


# --- M6 / M7 seasonal trend (tier 1) ---------------------------------------

def seasonal_sql(src: str, key: str | None, unit: str, periods: int, future: str | None = None,
                 min_rows: int = 10) -> str:
    """CTE chain ending in ``fc(key?, ds, yhat, yhat_lower, yhat_upper)``."""
    k = key or "_g"
    kcol = f"{key}" if key else "0 AS _g"
    part = "day" if unit == "day" else "month"
    elig = (f"SELECT {k}, ds, y FROM (SELECT {kcol}, ds, y FROM {src}) x "
            f"WHERE {k} IN (SELECT {k} FROM (SELECT {kcol} FROM {src}) z GROUP BY 1 HAVING COUNT(*) >= {min_rows})"
            if key else f"SELECT 0 AS _g, ds, y FROM {src}")
    step = "INTERVAL 1 DAY" if unit == "day" else "INTERVAL 1 MONTH"
    fut = future or (f"SELECT {k}, CAST(unnest(generate_series(last_ds + {step}, last_ds + {periods} * {step}, "
                     f"{step})) AS DATE) AS ds FROM params")
    week = unit == "day"

    def fitted(frm):
        j = (f"SELECT x.{k}, x.ds, x.y, p.a + p.b * CAST(date_diff('{part}', p.origin, x.ds) AS DOUBLE)"
             + (" + COALESCE(w.week_eff, 0.0)" if week else "")
             + " + CASE WHEN p.yearly THEN COALESCE(m.year_eff, 0.0) ELSE 0.0 END AS fitted"
             f" FROM {frm} x JOIN params p ON p.{k} = x.{k}"
             + (f" LEFT JOIN eff_w w ON w.{k} = x.{k} AND w.week_key = isodow(x.ds) - 1" if week else "")
             + f" LEFT JOIN eff_y m ON m.{k} = x.{k} AND m.year_key = month(x.ds)")
        return j

    def effect(name, expr):
        return (f"eff_{name} AS (SELECT s.{k}, {expr} AS {'week' if name == 'w' else 'year'}_key, "
                f"CAST(SUM(cents) AS DOUBLE) / 100.0 / CAST(COUNT(*) AS DOUBLE) - (p.a + p.b * "
                f"(CAST(SUM(t) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE))) AS {'week' if name == 'w' else 'year'}_eff "
                f"FROM s JOIN params p ON p.{k} = s.{k} GROUP BY s.{k}, 2, p.a, p.b)")

    return f"""s0 AS ({elig}),
span AS (SELECT {k}, MIN(ds) AS origin, MAX(ds) AS last_ds FROM s0 GROUP BY 1),
s AS (SELECT s0.{k}, s0.ds, s0.y, CAST(date_diff('{part}', span.origin, s0.ds) AS DECIMAL(38,0)) AS t,
             CAST(round(s0.y * 100) AS DECIMAL(38,0)) AS cents FROM s0 JOIN span ON span.{k} = s0.{k}),
g AS (SELECT {k}, CAST(COUNT(*) AS DECIMAL(38,0)) AS n, SUM(t) AS St, SUM(t * t) AS Stt, SUM(cents) AS SY,
             SUM(t * cents) AS StY FROM s GROUP BY 1),
gb AS (SELECT *, CASE WHEN CAST(n * Stt - St * St AS DOUBLE) <> 0
          THEN CAST(n * StY - St * SY AS DOUBLE) / CAST(n * Stt - St * St AS DOUBLE) / 100.0 ELSE 0.0 END AS b FROM g),
params AS (SELECT gb.{k}, (CAST(SY AS DOUBLE) / 100.0 - b * CAST(St AS DOUBLE)) / CAST(n AS DOUBLE) AS a, b,
                  span.origin, span.last_ds, date_diff('day', span.origin, span.last_ds) >= 730 AS yearly
           FROM gb JOIN span ON span.{k} = gb.{k}),
{effect('y', 'CAST(month(ds) AS INTEGER)')},
{effect('w', 'CAST(isodow(ds) - 1 AS INTEGER)') + ',' if week else ''}
fh AS ({fitted('s0')}),
sig AS (SELECT {k}, COALESCE(stddev_samp(y - fitted), 0.0) AS sigma FROM fh GROUP BY 1),
fut AS ({fut}),
ff AS ({fitted('(SELECT *, CAST(NULL AS DOUBLE) AS y FROM fut)')}),
fc AS (SELECT {'ff.' + k + ', ' if key else ''}ff.ds, {heven('greatest(fitted, 0.0)', 4)} AS yhat,
              {heven(f'greatest(fitted - {Z} * sigma, 0.0)', 4)} AS yhat_lower,
              {heven(f'fitted + {Z} * sigma', 4)} AS yhat_upper
       FROM ff JOIN sig ON sig.{k} = ff.{k})"""


@register("seasonal_trend_forecast", f"WITH {DAILY}, {seasonal_sql('d', 'user_id', 'day', 30)} SELECT * FROM fc",
          ED)
def q_seasonal_trend_forecast(spark, sf):
    return M.seasonal_trend_forecast(R.daily_totals(exp_daily(spark, sf)), 30)


MS_CAST = "msd AS (SELECT CAST(ds AS DATE) AS ds, y FROM ms)"


@register("seasonal_trend_monthly",
          f"WITH {MONTHLY}, {MS_CAST}, {seasonal_sql('msd', None, 'month', 6)} SELECT * FROM fc", EM)
def q_seasonal_trend_monthly(spark, sf):
    return M.seasonal_trend_forecast(monthly(spark, sf), 6, keys=(), unit="month")


# holdout: fit on all but the last 6 months, predict those 6
HOLD = """ranked AS (SELECT *, row_number() OVER (ORDER BY ds DESC) AS rn FROM msd),
train AS (SELECT ds, y FROM ranked WHERE rn > 6),
test AS (SELECT ds, y FROM ranked WHERE rn <= 6)"""
HOLD_FC = seasonal_sql("train", None, "month", 6, future="SELECT 0 AS _g, ds FROM test")
AVP = "avp AS (SELECT t.ds, t.y AS actual, fc.yhat AS predicted FROM test t JOIN fc USING (ds))"


def holdout_predictions(spark, sf):
    ser = S.temporal_holdout(monthly(spark, sf), 6)
    train = ser.filter(F.col("split") == "train").select("ds", "y")
    test = ser.filter(F.col("split") == "test").select("ds", "y")
    fc = M.seasonal_trend_forecast(train, 6, keys=(), unit="month", future=test.select("ds"))
    return test.join(fc, "ds").select("ds", F.col("y").alias("actual"),
                                      F.col("yhat").alias("predicted"))


@register("actual_vs_predicted", f"WITH {MONTHLY}, {MS_CAST}, {HOLD}, {HOLD_FC}, {AVP} SELECT * FROM avp", EM)
def q_actual_vs_predicted(spark, sf):
    return holdout_predictions(spark, sf)


@register("regression_metrics", f"""WITH {MONTHLY}, {MS_CAST}, {HOLD}, {HOLD_FC}, {AVP}
SELECT COUNT(*) AS n, {heven('AVG(abs(actual - predicted))', 4)} AS mae,
       {heven('sqrt(AVG((actual - predicted) * (actual - predicted)))', 4)} AS rmse,
       {heven('1 - SUM((actual - predicted) * (actual - predicted)) / SUM((actual - (SELECT AVG(actual) FROM avp)) * (actual - (SELECT AVG(actual) FROM avp)))', 6)} AS r2
FROM avp""", EM)
def q_regression_metrics(spark, sf):
    from ..operators.evaluate import regression_metrics
    return regression_metrics(holdout_predictions(spark, sf))


def _waves(dow: str, doy: str) -> str:
    week = [f"{f}(2 * pi() * {k} * {dow} / 7)" for k in (1, 2, 3) for f in ("sin", "cos")]
    year = [f"{f}(2 * pi() * {k} * {doy} / 365.25)" for k in range(1, 11) for f in ("sin", "cos")]
    return f"[{', '.join(week)}] || CASE WHEN yearly THEN [{', '.join(year)}] ELSE []::DOUBLE[] END"


def _design_sql(t: str, ds: str) -> str:
    return f"[1.0, {t}] || list_transform(cps, lambda c: greatest(0.0, {t} - c)) || {_waves(f'(isodow({ds}) - 1)', f'dayofyear({ds})')}"


#: Gauss-Jordan elimination of every user's normal equations, a column a step
TIER2_SQL = f"""
WITH RECURSIVE d AS (SELECT user_id, date AS ds, {msum('amount')} AS y FROM exp_daily WHERE date IS NOT NULL GROUP BY 1, 2),
u AS (SELECT user_id, MIN(ds) AS lo, MAX(ds) AS last_ds, COUNT(*) AS n, greatest(date_diff('day', MIN(ds), MAX(ds)), 1) AS span,
             greatest(date_diff('day', MIN(ds), MAX(ds)), 1) >= 730 AS yearly, list(ds ORDER BY ds) AS days FROM d GROUP BY 1),
e AS (SELECT *, list_transform(days[:greatest(CAST(floor(n * 0.8) AS BIGINT), 1)],
                               lambda x: date_diff('day', lo, x) / span) AS early FROM u WHERE n >= {MIN_HISTORY['seasonal']}),
q AS (SELECT *, list_transform(list_transform(range(1, 26), lambda k: (len(early) - 1) * (k / 26)),
        lambda p: early[CAST(floor(p) AS BIGINT) + 1] + (early[least(CAST(floor(p) AS BIGINT) + 2, len(early))]
                  - early[CAST(floor(p) AS BIGINT) + 1]) * (p - floor(p))) AS cps FROM e),
x AS (SELECT user_id, y, {_design_sql("(date_diff('day', lo, ds) / span)", "ds")} AS x FROM d JOIN q USING (user_id)),
cells AS (SELECT user_id, i, j, SUM(x[i] * CASE WHEN j <= len(x) THEN x[j] ELSE y END) + CASE WHEN i = j AND i > 2 THEN 1.0 ELSE 0.0 END AS v
          FROM (SELECT user_id, x, y, i, unnest(range(1, len(x) + 2)) AS j
                FROM (SELECT user_id, x, y, unnest(range(1, len(x) + 1)) AS i FROM x)) GROUP BY 1, 2, 3),
m AS (SELECT user_id, list(r ORDER BY i) AS a FROM (SELECT user_id, i, list(v ORDER BY j) AS r FROM cells GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT user_id, 1 AS k, a FROM m
      UNION ALL SELECT user_id, k + 1, list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k])
        ELSE list_transform(r, lambda v, j: v - r[k] * a[k][j] / a[k][k]) END) FROM g WHERE k <= len(a)),
b AS (SELECT user_id, list_transform(a, lambda r: r[-1]) AS beta FROM g WHERE k = len(a) + 1),
res AS (SELECT user_id, coalesce(stddev_samp(y - list_dot_product(x, beta)), 0.0) AS sigma FROM x JOIN b USING (user_id) GROUP BY 1),
f AS (SELECT user_id, ds, list_dot_product({_design_sql("(date_diff('day', lo, ds) / span)", "ds")}, beta) AS p, sigma
      FROM (SELECT q.*, CAST(last_ds + CAST(unnest(range(1, 31)) AS INTEGER) AS DATE) AS ds FROM q) JOIN b USING (user_id) JOIN res USING (user_id))
SELECT user_id, ds, {heven('greatest(p, 0.0)', 4)} AS yhat, {heven(f'greatest(p - {INTERVAL_Z80} * sigma, 0.0)', 4)} AS yhat_lower,
       {heven(f'(p + {INTERVAL_Z80} * sigma)', 4)} AS yhat_upper FROM f"""


@register("seasonal_trend_regression", TIER2_SQL, ("exp_daily",))
def q_seasonal_trend_regression(spark, sf):
    fc = M.seasonal_trend_regression(R.daily_totals(exp_daily(spark, sf)), 30)
    return fc.select("user_id", "ds", *[half_even(c, 4).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])
