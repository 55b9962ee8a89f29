"""Scans, filters, ledger change sets and budget queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import currency_label
from ..operators import budget as B
from ..operators import filters as P
from ..operators import ledger as L
from ..operators import reports as R
from ..operators.note_index import NoteIndex
from ..session import tables_root
from ..sources.tables import (budget_changes, budgets, changes, exp_daily, exp_monthly,
                              purge_users, users)
from .q_reports import msum, pyround
from .registry import register

# --- scans and filters ----------------------------------------------------

@register("scan_expenses", "SELECT * FROM exp_daily", ("exp_daily",))
def q_scan_expenses(spark, sf):
    return P.scan_expenses(exp_daily(spark, sf))


@register("scan_budgets", "SELECT * FROM budgets WHERE month = '2024-01'", ("budgets",))
def q_scan_budgets(spark, sf):
    return P.scan_budgets(budgets(spark, sf), "2024-01")


@register("filter_expenses", """
SELECT * FROM exp_daily WHERE date >= DATE '2024-01-08' AND date <= DATE '2024-01-21'
  AND payment_mode = 'UPI'""", ("exp_daily",))
def q_filter_expenses(spark, sf):
    return P.filter_expenses(exp_daily(spark, sf), "2024-01-08", "2024-01-21", "All", "UPI")


SEARCH = ": 1[0-9]"


@register("search_notes", f"""
SELECT * FROM exp_daily WHERE COALESCE(regexp_matches(notes, '{SEARCH}', 'i'), false)""",
          ("exp_daily",))
def q_search_notes(spark, sf):
    return P.search_notes(exp_daily(spark, sf), SEARCH)


_HIST = f"""h AS (SELECT user_id, id, date, category, amount, payment_mode, notes FROM exp_daily
  WHERE category = 'view' AND COALESCE(regexp_matches(notes, '{SEARCH}', 'i'), false))"""


@register("expense_history", f"WITH {_HIST} SELECT * FROM h", ("exp_daily",))
def q_expense_history(spark, sf):
    return P.expense_history(exp_daily(spark, sf), SEARCH, "view", "All", "amount_desc")


@register("history_totals", f"""WITH {_HIST}
SELECT user_id, {msum('amount')} AS total, COUNT(amount) AS n, {msum('amount')} / COUNT(amount) AS mean
FROM h GROUP BY 1""", ("exp_daily",))
def q_history_totals(spark, sf):
    return R.history_totals(P.expense_history(exp_daily(spark, sf), SEARCH, "view", "All",
                                              "amount_desc"))


# --- ledger ---------------------------------------------------------------

def _ops(spark, sf, op):
    return changes(spark, sf).filter(F.col("op") == op)


@register("append_expenses", """
SELECT id, user_id, date, category, amount, payment_mode, notes FROM exp_daily
UNION ALL
SELECT id, user_id, date, category, amount, COALESCE(payment_mode, 'Cash'), COALESCE(notes, '')
FROM changes WHERE op = 'insert'""", ("exp_daily", "changes"))
def q_append_expenses(spark, sf):
    return L.append_expenses(exp_daily(spark, sf), _ops(spark, sf, "insert"))


@register("apply_expense_updates", """
WITH lp AS (SELECT id, user_id, arg_max(date, seq) FILTER (WHERE date IS NOT NULL) AS date,
                   arg_max(category, seq) FILTER (WHERE category IS NOT NULL) AS category,
                   arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS amount,
                   arg_max(payment_mode, seq) FILTER (WHERE payment_mode IS NOT NULL) AS payment_mode,
                   arg_max(notes, seq) FILTER (WHERE notes IS NOT NULL) AS notes
            FROM changes WHERE op = 'update' GROUP BY id, user_id)
SELECT e.id, e.user_id, COALESCE(lp.date, e.date) AS date, COALESCE(lp.category, e.category) AS category,
       COALESCE(lp.amount, e.amount) AS amount, COALESCE(lp.payment_mode, e.payment_mode) AS payment_mode,
       COALESCE(lp.notes, e.notes) AS notes
FROM exp_daily e LEFT JOIN lp ON lp.id = e.id AND lp.user_id = e.user_id""", ("exp_daily", "changes"))
def q_apply_expense_updates(spark, sf):
    return L.apply_expense_updates(exp_daily(spark, sf), _ops(spark, sf, "update"))


@register("delete_expenses", """
SELECT * FROM exp_daily e WHERE NOT EXISTS (
  SELECT 1 FROM changes c WHERE c.op = 'delete' AND c.id = e.id AND c.user_id = e.user_id)""",
          ("exp_daily", "changes"))
def q_delete_expenses(spark, sf):
    return L.delete_expenses(exp_daily(spark, sf), _ops(spark, sf, "delete"))


@register("purge_user_expenses", """
SELECT * FROM exp_monthly e WHERE NOT EXISTS (SELECT 1 FROM purge_users p WHERE p.user_id = e.user_id)""",
          ("exp_monthly", "purge_users"))
def q_purge_user_expenses(spark, sf):
    return L.purge_user_expenses(exp_monthly(spark, sf), purge_users(spark, sf))


@register("purge_user_cascade", """
SELECT 'expenses' AS tbl, user_id, COUNT(*) AS n_rows FROM exp_monthly e
WHERE NOT EXISTS (SELECT 1 FROM purge_users p WHERE p.user_id = e.user_id) GROUP BY 2
UNION ALL
SELECT 'budgets', user_id, COUNT(*) FROM budgets b
WHERE NOT EXISTS (SELECT 1 FROM purge_users p WHERE p.user_id = b.user_id) GROUP BY 2""",
          ("exp_monthly", "budgets", "purge_users"))
def q_purge_user_cascade(spark, sf):
    out = L.purge_user_cascade({"expenses": exp_monthly(spark, sf), "budgets": budgets(spark, sf)},
                               purge_users(spark, sf))
    parts = [t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("tbl"), "user_id", "n_rows") for name, t in out.items()]
    return parts[0].unionByName(parts[1])


@register("upsert_budgets", """
WITH nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, month, category ORDER BY seq DESC) AS rn
                           FROM budget_changes) WHERE rn = 1)
SELECT COALESCE(b.user_id, nw.user_id) AS user_id, COALESCE(b.month, nw.month) AS month,
       COALESCE(b.category, nw.category) AS category, COALESCE(nw.budget_amount, b.budget_amount) AS budget_amount
FROM budgets b FULL OUTER JOIN nw ON b.user_id = nw.user_id AND b.month = nw.month AND b.category = nw.category""",
          ("budgets", "budget_changes"))
def q_upsert_budgets(spark, sf):
    return L.upsert_budgets(budgets(spark, sf), budget_changes(spark, sf))


@register("check_unique_budgets", """
SELECT user_id, month, category, COUNT(*) AS n FROM budget_changes GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""",
          ("budget_changes",))
def q_check_unique_budgets(spark, sf):
    return L.check_unique(budget_changes(spark, sf), L.BUDGET_KEY)


_REQ = ["id", "user_id", "date", "category", "amount", "payment_mode", "notes"]


@register("check_required_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM exp_monthly" for c in _REQ),
    ("exp_monthly",))
def q_check_required_columns(spark, sf):
    return L.check_required_columns(exp_monthly(spark, sf), _REQ)


@register("check_orphans", """
SELECT * FROM exp_monthly e WHERE NOT EXISTS (
  SELECT 1 FROM users u WHERE u.segment <> 'MACHINERY' AND u.id = e.user_id)""",
          ("exp_monthly", "users"))
def q_check_orphans(spark, sf):
    """Expenses left behind by the accounts of one market segment."""
    return L.check_orphans(exp_monthly(spark, sf), users(spark, sf).filter("segment <> 'MACHINERY'"))


# --- budgets --------------------------------------------------------------

_SPEND = f"""cs AS (SELECT user_id, strftime(date, '%Y-%m') AS month, category, {msum('amount')} AS spent
  FROM exp_daily WHERE date IS NOT NULL GROUP BY 1, 2, 3),
ms AS (SELECT user_id, month, CAST(SUM(CAST(spent AS DECIMAL(28,6))) AS DOUBLE) AS spent FROM cs GROUP BY 1, 2)"""
_PCT = "CASE WHEN budget_amount > 0 THEN least(spent / budget_amount * 100, 100.0) ELSE 0.0 END"
_BAND = "CASE WHEN pct < 70.0 THEN 'ok' WHEN pct < 90.0 THEN 'warn' ELSE 'over' END"
BV = ("budgets", "exp_daily")


@register("budget_vs_actual", f"""WITH {_SPEND}
SELECT b.user_id, b.month, b.category, b.budget_amount, COALESCE(cs.spent, 0.0) AS spent
FROM budgets b LEFT JOIN cs USING (user_id, month, category) WHERE b.category <> 'Overall'""", BV)
def q_budget_vs_actual(spark, sf):
    return B.budget_vs_actual(budgets(spark, sf), exp_daily(spark, sf))


@register("budget_overall", f"""WITH {_SPEND},
j AS (SELECT b.user_id, b.month, b.budget_amount, COALESCE(ms.spent, 0.0) AS spent
      FROM budgets b LEFT JOIN ms USING (user_id, month) WHERE b.category = 'Overall'),
p AS (SELECT *, {_PCT} AS pct FROM j)
SELECT user_id, month, budget_amount, spent, pct, {_BAND} AS band, pct >= 100 AS over_budget,
       CASE WHEN pct >= 100 THEN spent - budget_amount END AS over_by,
       CASE WHEN NOT pct >= 100 THEN budget_amount - spent END AS remaining
FROM p""", BV)
def q_budget_overall(spark, sf):
    return B.budget_overall(budgets(spark, sf), exp_daily(spark, sf))


_BYCAT = f"""{_SPEND},
j AS (SELECT b.user_id, b.month, b.category, b.budget_amount, COALESCE(cs.spent, 0.0) AS spent
      FROM budgets b LEFT JOIN cs USING (user_id, month, category) WHERE b.category <> 'Overall'),
p AS (SELECT *, {_PCT} AS pct FROM j)"""


@register("budget_by_category", f"""WITH {_BYCAT}
SELECT user_id, month, category, budget_amount, spent, pct, {_BAND} AS band,
       budget_amount - spent AS remaining, budget_amount - spent < 0 AS over_budget FROM p""", BV)
def q_budget_by_category(spark, sf):
    return B.budget_by_category(budgets(spark, sf), exp_daily(spark, sf))


@register("status_band", f"""WITH {_BYCAT}
SELECT user_id, month, category, pct, {_BAND} AS band FROM p""", BV)
def q_status_band(spark, sf):
    return B.budget_by_category(budgets(spark, sf), exp_daily(spark, sf)).select(
        "user_id", "month", "category", "pct", "band")


@register("budget_alerts", f"""WITH {_SPEND},
sp AS (SELECT user_id, month, category, spent FROM cs UNION ALL SELECT user_id, month, 'Overall', spent FROM ms),
j AS (SELECT b.*, sp.spent, CASE WHEN b.budget_amount <> 0 THEN sp.spent / b.budget_amount END * 100 AS pct
      FROM budgets b JOIN sp USING (user_id, month, category))
SELECT user_id, month, category, budget_amount, spent, pct,
       CASE WHEN COALESCE(pct >= 100, true) THEN 'Over Budget' ELSE 'Approaching Limit' END AS alert
FROM j WHERE spent > budget_amount * 0.9""", BV)
def q_budget_alerts(spark, sf):
    return B.budget_alerts(budgets(spark, sf), exp_daily(spark, sf))


@register("currency_label", f"""
WITH m AS (SELECT user_id, strftime(date, '%Y-%m') AS month, {msum('amount')} AS total
           FROM exp_monthly WHERE date IS NOT NULL GROUP BY 1, 2)
SELECT *, '₹' || CASE WHEN total >= 100000 THEN format('{{:.1f}}', {pyround('(total / 100000)', 1)}) || 'L'
               WHEN total >= 1000 THEN format('{{:.1f}}', {pyround('(total / 1000)', 1)}) || 'K'
               ELSE format('{{:,.0f}}', round_even(total, 0)) END AS label
FROM m""", ("exp_monthly",))
def q_currency_label(spark, sf):
    return R.monthly_totals(exp_monthly(spark, sf)).withColumn("label", currency_label("total"))


# --- note search by index -----------------------------------------------------

#: anchored, alternative, optional, repeated, open and trigram-less patterns
PATTERNS = [": 1[0-9]", "\"K\": [0-9]7", "^\\{.*9\\}$", "(: 2|: 3)[05]", "k\"?: 4+", "7", ": (12|34|56)\\}", "nothing like it"]


@register("search_notes_indexed", " UNION ALL ".join(
    f"SELECT {i} AS pattern, * FROM exp_daily WHERE COALESCE(regexp_matches(notes, '{p}', 'i'), false)"
    for i, p in enumerate(PATTERNS)), ("exp_daily",))
def q_search_notes_indexed(spark, sf):
    e = exp_daily(spark, sf)
    index = NoteIndex.build(e, f"{tables_root(spark)}/notes-{uuid.uuid4().hex}")
    out = None
    for i, p in enumerate(PATTERNS):
        one = index.search(p).select(F.lit(i).alias("pattern"), *e.columns)
        out = one if out is None else out.unionByName(one)
    return out
