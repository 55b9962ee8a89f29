"""Report queries (A*, W1, W10, T*) over the expense views."""

from __future__ import annotations

from ..operators import reports as R
from ..sources.tables import exp_daily, exp_monthly
from .registry import register

# SQL helpers (DuckDB): exact money sum and pandas rounding
MSUM = "CAST(SUM(CAST({x} AS DECIMAL(28,6))) AS DOUBLE)"
def msum(x: str) -> str:
    return MSUM.format(x=x)
def pyround(x: str, d: int = 2) -> str:
    """Python's round: the exact product decides ties (see ``py_round``)."""
    p, hi = f"({x} * {10 ** d}.0::DOUBLE)", f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    err = f"(({hi} * {10 ** d}.0::DOUBLE - {p}) + ({x} - {hi}) * {10 ** d}.0::DOUBLE)"
    gap = f"({p} - floor({p}) - 0.5::DOUBLE)"
    return (f"CASE WHEN {gap} > 0 OR ({gap} = 0 AND ({err} > 0 OR ({err} = 0 AND CAST(floor({p}) AS BIGINT) % 2 <> 0))) "
            f"THEN floor({p}) + 1 ELSE floor({p}) END / {10 ** d}.0::DOUBLE")
def heven(x: str, d: int = 2) -> str:
    return f"round_even(({x}) * {10 ** d}.0, 0) / {10 ** d}.0"


@register("monthly_totals", f"""
SELECT user_id, strftime(date, '%Y-%m') AS month, COALESCE({msum('amount')}, 0.0) AS total
FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1, 2""", ("exp_monthly",))
def q_monthly_totals(spark, sf):
    return R.monthly_totals(exp_monthly(spark, sf))


@register("daily_totals", f"""
SELECT user_id, date AS ds, COALESCE({msum('amount')}, 0.0) AS y
FROM exp_daily WHERE date IS NOT NULL GROUP BY 1, 2""", ("exp_daily",))
def q_daily_totals(spark, sf):
    return R.daily_totals(exp_daily(spark, sf))


def first_by(src: str, key: str, val: str, order: str, alias_key: str, alias_val: str) -> str:
    """SQL: per user, the key with the largest/smallest value, ties -> smallest key."""
    return (f"SELECT user_id, {key} AS {alias_key}, {val} AS {alias_val} FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {val} {order}, {key} ASC) AS rn "
            f"FROM {src}) WHERE rn = 1")


@register("category_summary", f"""
SELECT user_id, category, COALESCE({msum('amount')}, 0.0) AS total, COUNT(amount) AS n,
       {msum('amount')} / COUNT(amount) AS mean
FROM exp_daily GROUP BY 1, 2""", ("exp_daily",))
def q_category_summary(spark, sf):
    return R.category_summary(exp_daily(spark, sf))


@register("category_analysis", f"""
WITH per AS (
  SELECT user_id, category, {heven(msum('amount'))} AS total, COUNT(amount) AS n,
         {heven(msum('amount') + ' / COUNT(amount)')} AS average,
         {heven('MIN(amount)')} AS min_amount, {heven('MAX(amount)')} AS max_amount
  FROM exp_monthly GROUP BY 1, 2)
SELECT *, {heven('total / CAST(SUM(CAST(total AS DECIMAL(28,6))) OVER (PARTITION BY user_id) AS DOUBLE) * 100', 1)} AS share_pct
FROM per""", ("exp_monthly",))
def q_category_analysis(spark, sf):
    return R.category_analysis(exp_monthly(spark, sf))


@register("month_category_summary", f"""
SELECT user_id, strftime(date, '%Y-%m') AS month, category, {heven(msum('amount'))} AS total,
       COUNT(amount) AS n, {heven(msum('amount') + ' / COUNT(amount)')} AS average
FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1, 2, 3""", ("exp_monthly",))
def q_month_category_summary(spark, sf):
    return R.month_category_summary(exp_monthly(spark, sf))


_MONTHS = f"""m AS (SELECT user_id, strftime(date, '%Y-%m') AS month, {msum('amount')} AS total
  FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1, 2),
top2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS rn FROM m) WHERE rn <= 2),
g AS (SELECT user_id, MAX(CASE WHEN rn = 1 THEN month END) AS last_month,
         MAX(CASE WHEN rn = 1 THEN total END) AS last_total,
         MAX(CASE WHEN rn = 2 THEN month END) AS prev_month,
         MAX(CASE WHEN rn = 2 THEN total END) AS prev_total FROM top2 GROUP BY 1)"""
_GROWTH = "CASE WHEN prev_total > 0 THEN (last_total - prev_total) / prev_total * 100 ELSE 0.0 END"


@register("month_growth", f"""
WITH {_MONTHS}
SELECT *, {_GROWTH} AS growth_pct FROM g""", ("exp_monthly",))
def q_month_growth(spark, sf):
    return R.month_growth(exp_monthly(spark, sf))


@register("insights", f"""
WITH {_MONTHS},
c AS (SELECT user_id, category, {msum('amount')} AS total FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1, 2),
mx AS ({first_by('m', 'month', 'total', 'DESC', 'highest_month', 'highest_amount')}),
mn AS ({first_by('m', 'month', 'total', 'ASC', 'lowest_month', 'lowest_amount')}),
tc AS ({first_by('c', 'category', 'total', 'DESC', 'top_category', 'top_category_amount')}),
b AS (SELECT user_id, COUNT(amount) AS total_transactions,
        {msum('amount')} / COUNT(amount) AS a,
        COALESCE({msum("CASE WHEN isodow(date) >= 6 THEN amount END")} / COUNT(CASE WHEN isodow(date) >= 6 THEN amount END), 0.0) AS we,
        COALESCE({msum("CASE WHEN isodow(date) < 6 THEN amount END")} / COUNT(CASE WHEN isodow(date) < 6 THEN amount END), 0.0) AS wd
      FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1)
SELECT b.user_id, highest_month, {pyround('highest_amount')} AS highest_amount, lowest_month,
       {pyround('lowest_amount')} AS lowest_amount, top_category,
       {pyround('top_category_amount')} AS top_category_amount, {heven(_GROWTH)} AS growth_rate,
       {pyround('we')} AS weekend_avg, {pyround('wd')} AS weekday_avg, total_transactions,
       {pyround('a')} AS avg_transaction
FROM b JOIN mx USING (user_id) JOIN mn USING (user_id) JOIN tc USING (user_id) JOIN g USING (user_id)""",
          ("exp_monthly",))
def q_insights(spark, sf):
    return R.insights(exp_monthly(spark, sf)).drop("monthly_totals", "category_totals")


@register("insight_lists", f"""
WITH {_MONTHS},
c AS (SELECT user_id, category, {msum('amount')} AS total FROM exp_monthly
      WHERE date IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
l AS (SELECT user_id, 'monthly_totals' AS list, month AS name, total FROM m
      UNION ALL SELECT user_id, 'category_totals', category, total FROM c)
SELECT user_id, list, CAST(row_number() OVER (PARTITION BY user_id, list ORDER BY name) - 1 AS INTEGER) AS position,
       name, total FROM l""", ("exp_monthly",))
def q_insight_lists(spark, sf):
    return R.insight_lists(R.insights(exp_monthly(spark, sf)))


@register("dashboard_kpis", f"""
WITH w AS (SELECT * FROM exp_daily WHERE date >= DATE '2024-01-01' AND date <= DATE '2024-01-21'),
c AS (SELECT user_id, category, {msum('amount')} AS total FROM w GROUP BY 1, 2),
tc AS ({first_by('c', 'category', 'total', 'DESC', 'top_category', 'top_category_amount')}),
b AS (SELECT user_id, {msum('amount')} AS total, COUNT(amount) AS n_transactions FROM w GROUP BY 1)
SELECT b.user_id, total, total / 20.0 AS avg_daily, n_transactions,
       total / greatest(n_transactions, 1) AS avg_per_transaction, top_category, top_category_amount
FROM b JOIN tc USING (user_id)""", ("exp_daily",))
def q_dashboard_kpis(spark, sf):
    return R.dashboard_kpis(exp_daily(spark, sf), "2024-01-01", "2024-01-21")


@register("month_over_month", f"""
WITH g AS (SELECT user_id,
  COALESCE({msum("CASE WHEN date >= DATE '2000-06-01' THEN amount END")}, 0.0) AS this_month,
  COALESCE({msum("CASE WHEN date >= DATE '2000-05-01' AND date < DATE '2000-06-01' THEN amount END")}, 0.0) AS last_month
  FROM exp_monthly GROUP BY 1)
SELECT *, CASE WHEN last_month > 0 THEN (this_month - last_month) / last_month * 100 ELSE 0.0 END AS mom_change_pct
FROM g""", ("exp_monthly",))
def q_month_over_month(spark, sf):
    return R.month_over_month(exp_monthly(spark, sf), "2000-06-15")


@register("weekend_weekday_split", f"""
SELECT user_id, isodow(date) >= 6 AS is_weekend, {msum('amount')} AS total,
       {msum('amount')} / COUNT(amount) AS avg_per_transaction, COUNT(amount) AS n
FROM exp_daily WHERE date IS NOT NULL GROUP BY 1, 2""", ("exp_daily",))
def q_weekend_weekday_split(spark, sf):
    return R.weekend_weekday_split(exp_daily(spark, sf))


@register("weekday_means", f"""
WITH s AS (SELECT user_id, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
                  {msum('amount')} / COUNT(amount) AS mean_amount
           FROM exp_daily WHERE date IS NOT NULL GROUP BY 1, 2),
u AS (SELECT DISTINCT user_id FROM exp_daily WHERE date IS NOT NULL)
SELECT u.user_id, CAST(w.weekday AS INTEGER) AS weekday, s.mean_amount
FROM u CROSS JOIN range(7) AS w(weekday)
LEFT JOIN s ON s.user_id = u.user_id AND s.weekday = w.weekday""", ("exp_daily",))
def q_weekday_means(spark, sf):
    return R.weekday_means(exp_daily(spark, sf))


@register("account_statistics", f"""
SELECT user_id, {msum('amount')} AS total_spent, COUNT(amount) AS total_transactions,
       MIN(date) AS first_expense, MAX(date) AS last_expense,
       {msum('amount')} / COUNT(amount) AS avg_transaction,
       COUNT(DISTINCT category) AS categories_used
FROM exp_monthly GROUP BY 1""", ("exp_monthly",))
def q_account_statistics(spark, sf):
    return R.account_statistics(exp_monthly(spark, sf))


@register("expense_summary", f"""
WITH c AS (SELECT user_id, category, {msum('amount')} AS total FROM exp_monthly GROUP BY 1, 2),
tc AS ({first_by('c', 'category', 'total', 'DESC', 'top_category', 'top_total')}),
b AS (SELECT user_id, {msum('amount')} AS total_expenses, COUNT(amount) AS total_transactions,
        {msum('amount')} / COUNT(amount) AS avg_transaction, MAX(amount) AS max_transaction,
        MIN(amount) AS min_transaction,
        CAST(MIN(date) AS VARCHAR) || ' to ' || CAST(MAX(date) AS VARCHAR) AS date_range
      FROM exp_monthly GROUP BY 1)
SELECT b.*, top_category FROM b JOIN tc USING (user_id)""", ("exp_monthly",))
def q_expense_summary(spark, sf):
    return R.expense_summary(exp_monthly(spark, sf))


def _quantile_sql(src: str, col: str, probs, names) -> str:
    parts = []
    for p, n in zip(probs, names):
        pos = f"((SELECT COUNT(*) FROM {src}) - 1) * {p}"
        lo = f"(SELECT {col} FROM ord WHERE r = floor({pos}))"
        hi = f"(SELECT {col} FROM ord WHERE r = ceil({pos}))"
        fr = f"({pos} - floor({pos}))"
        parts.append(f"CASE WHEN {fr} >= 0.5 THEN {hi} - ({hi} - {lo}) * (1.0 - {fr}) "
                     f"ELSE {lo} + ({hi} - {lo}) * {fr} END AS {n}")
    return ", ".join(parts)


@register("describe_amount", f"""
WITH x AS (SELECT amount FROM exp_monthly WHERE amount IS NOT NULL),
ord AS (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS r FROM x)
SELECT COUNT(amount) AS count, {msum('amount')} / COUNT(amount) AS mean,
       {heven('stddev_samp(amount)', 6)} AS std, MIN(amount) AS min, MAX(amount) AS max,
       {_quantile_sql('x', 'amount', [0.25, 0.5, 0.75], ['q25', 'q50', 'q75'])}
FROM x""", ("exp_monthly",))
def q_describe_amount(spark, sf):
    return R.describe_amount(exp_monthly(spark, sf))


def _describe_sql(keys: str, view: str) -> str:
    """Quartiles of every key by rank, with the same interpolation."""
    def quartile(p):
        at = f"({p} * (n - 1))"
        lo, hi, fr = (f"MAX(CASE WHEN r = floor({at}) THEN amount END)", f"MAX(CASE WHEN r = ceil({at}) THEN amount END)",
                      f"MAX({at} - floor({at}))")
        return f"CASE WHEN {fr} >= 0.5 THEN {hi} - ({hi} - {lo}) * (1.0 - {fr}) ELSE {lo} + ({hi} - {lo}) * {fr} END"
    return f"""
WITH ord AS (SELECT {keys}, amount, row_number() OVER (PARTITION BY {keys} ORDER BY amount) - 1 AS r,
                    COUNT(*) OVER (PARTITION BY {keys}) AS n FROM {view} WHERE amount IS NOT NULL)
SELECT {keys}, COUNT(amount) AS count, {msum('amount')} / COUNT(amount) AS mean, {heven('stddev_samp(amount)', 4)} AS std,
       MIN(amount) AS min, {quartile(0.25)} AS q25, {quartile(0.5)} AS q50, {quartile(0.75)} AS q75, MAX(amount) AS max
FROM ord GROUP BY {keys}"""


@register("describe_amount_by_user", _describe_sql("user_id", "exp_monthly"), ("exp_monthly",))
def q_describe_amount_by_user(spark, sf):
    return R.describe_by_key(exp_monthly(spark, sf), ["user_id"])


@register("describe_amount_by_category", _describe_sql("category, payment_mode", "exp_daily"), ("exp_daily",))
def q_describe_amount_by_category(spark, sf):
    return R.describe_by_key(exp_daily(spark, sf), ["category", "payment_mode"])


@register("distinct_notes", """
SELECT COUNT(DISTINCT notes) AS distinct_notes FROM exp_daily""", ("exp_daily",))
def q_distinct_notes(spark, sf):
    return R.distinct_notes(exp_daily(spark, sf))


@register("weekly_heatmap", ", ".join(
    ["SELECT user_id, CAST(weekofyear(date) AS INTEGER) AS week"] +
    [f"COALESCE({msum(f'CASE WHEN isodow(date) = {i + 1} THEN amount END')}, 0.0) AS {d}"
     for i, d in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"])])
    + " FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1, 2", ("exp_monthly",))
def q_weekly_heatmap(spark, sf):
    return R.weekly_heatmap(exp_monthly(spark, sf))


@register("amount_histogram", """
WITH r AS (SELECT user_id, MIN(amount) AS lo, MAX(amount) AS hi FROM exp_daily WHERE amount IS NOT NULL GROUP BY 1),
j AS (SELECT e.user_id, e.amount, r.lo, r.hi,
        CAST(CASE WHEN r.hi - r.lo > 0 THEN least(floor((e.amount - r.lo) / (r.hi - r.lo) * 30) + 1, 30)
             ELSE 1 END AS INTEGER) AS bin
      FROM exp_daily e JOIN r USING (user_id) WHERE e.amount IS NOT NULL)
SELECT user_id, bin, COUNT(*) AS n, lo + (hi - lo) * (bin - 1) / 30 AS bin_lo
FROM j GROUP BY user_id, bin, lo, hi""", ("exp_daily",))
def q_amount_histogram(spark, sf):
    return R.amount_histogram(exp_daily(spark, sf))


_RANKED = f"""t AS (SELECT user_id, category, {msum('amount')} AS total FROM {{src}} GROUP BY 1, 2),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category ASC) AS INTEGER) AS rank FROM t)"""


@register("category_breakdown", f"""
WITH {_RANKED.format(src='exp_daily')}
SELECT *, total / CAST(SUM(CAST(total AS DECIMAL(28,6))) OVER (PARTITION BY user_id) AS DOUBLE) * 100 AS share_pct
FROM rk WHERE rank <= 8""", ("exp_daily",))
def q_category_breakdown(spark, sf):
    return R.category_breakdown(exp_daily(spark, sf))


@register("top_categories", f"""
WITH {_RANKED.format(src='exp_daily')}
SELECT * FROM rk WHERE rank <= 8""", ("exp_daily",))
def q_top_categories(spark, sf):
    return R.top_categories(exp_daily(spark, sf))


@register("category_trend", f"""
WITH {_RANKED.format(src='exp_monthly')}
SELECT e.user_id, e.category, strftime(e.date, '%Y-%m') AS month, {msum('e.amount')} AS total
FROM exp_monthly e JOIN rk ON rk.user_id = e.user_id AND rk.category = e.category AND rk.rank <= 5
WHERE e.date IS NOT NULL GROUP BY 1, 2, 3""", ("exp_monthly",))
def q_category_trend(spark, sf):
    return R.category_trend(exp_monthly(spark, sf))


@register("null_profile", """
SELECT * FROM (VALUES
 ('id', 'bigint', (SELECT COUNT(id) FROM exp_monthly)),
 ('user_id', 'bigint', (SELECT COUNT(user_id) FROM exp_monthly)),
 ('date', 'date', (SELECT COUNT(date) FROM exp_monthly)),
 ('category', 'string', (SELECT COUNT(category) FROM exp_monthly)),
 ('amount', 'double', (SELECT COUNT(amount) FROM exp_monthly)),
 ('payment_mode', 'string', (SELECT COUNT(payment_mode) FROM exp_monthly)),
 ('notes', 'string', (SELECT COUNT(notes) FROM exp_monthly))) AS v(column_name, dtype, non_null),
 (SELECT COUNT(*) AS "rows" FROM exp_monthly)""", ("exp_monthly",))
def q_null_profile(spark, sf):
    return R.null_profile(exp_monthly(spark, sf))


@register("daily_moving_average", f"""
WITH d AS (SELECT user_id, date AS ds, {msum('amount')} AS y FROM exp_daily WHERE date IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS nn FROM d)
SELECT user_id, ds, y,
  CASE WHEN COUNT(y) OVER w = 7 THEN CAST(SUM(CAST(y AS DECIMAL(28,6))) OVER w AS DOUBLE) / 7 END AS ma7
FROM n WHERE nn > 7
WINDOW w AS (PARTITION BY user_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", ("exp_daily",))
def q_daily_moving_average(spark, sf):
    return R.daily_moving_average(exp_daily(spark, sf))


@register("recent_transactions", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS INTEGER) AS rank
               FROM exp_daily) WHERE rank <= 8""", ("exp_daily",))
def q_recent_transactions(spark, sf):
    return R.recent_transactions(exp_daily(spark, sf))


@register("largest_expenses", """
SELECT * FROM exp_monthly ORDER BY amount DESC, id ASC LIMIT 20""", ("exp_monthly",))
def q_largest_expenses(spark, sf):
    return R.largest_expenses(exp_monthly(spark, sf))


@register("sorted_history", """
SELECT * FROM exp_daily ORDER BY user_id, amount DESC, id""", ("exp_daily",))
def q_sorted_history(spark, sf):
    return R.sorted_history(exp_daily(spark, sf), by="amount", ascending=False)


@register("random_sample", """
SELECT * FROM exp_daily ORDER BY md5('42-' || CAST(id AS VARCHAR)), id LIMIT 20""", ("exp_daily",))
def q_random_sample(spark, sf):
    return R.random_sample(exp_daily(spark, sf), 20, 42)
