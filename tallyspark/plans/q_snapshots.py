"""Versioned ledger: change sets applied in a row, versions read side by side."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators.snapshots import Change, SnapshotStore, Table
from ..session import tables_root
from ..sources.tables import budget_changes, budgets, changes, exp_daily, purge_users
from .registry import register

COLS = "id, user_id, date, category, amount, payment_mode, notes"


def delete_and_insert(base, rows):
    """A change set of deletes and inserts."""
    kept = L.delete_expenses(base, rows.filter("op = 'delete'"))
    return L.append_expenses(kept, rows.filter("op = 'insert'"))


def ledger_store(spark, sf) -> SnapshotStore:
    """Version 0: expenses and budgets.  1: patches of the expenses and new
    budgets, in one switch.  2: deletes and inserts; an inserted row keeps the
    id it comes with, also where the table has a row of that id."""
    store = SnapshotStore.create(spark, f"{tables_root(spark)}/ledger-{uuid.uuid4().hex}", {
        "expenses": Table(exp_daily(spark, sf), ["id"], 16, True, ("id", "user_id")),
        "budgets": Table(budgets(spark, sf), L.BUDGET_KEY, 16, True, tuple(L.BUDGET_KEY))})
    todo = changes(spark, sf)
    store.commit({"expenses": Change(todo.filter("op = 'update'"), L.apply_expense_updates, L.EXPENSE_KEY),
                  "budgets": Change(budget_changes(spark, sf), L.upsert_budgets)})
    store.commit({"expenses": Change(todo.filter("op IN ('delete', 'insert')"), delete_and_insert, repeats=True)})
    return store


_V1 = f"""
lp AS (SELECT id, user_id, arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS amount,
              arg_max(payment_mode, seq) FILTER (WHERE payment_mode IS NOT NULL) AS payment_mode
       FROM changes WHERE op = 'update' GROUP BY id, user_id),
v1 AS (SELECT e.id, e.user_id, e.date, e.category, COALESCE(lp.amount, e.amount) AS amount,
              COALESCE(lp.payment_mode, e.payment_mode) AS payment_mode, e.notes
       FROM exp_daily e LEFT JOIN lp ON lp.id = e.id AND lp.user_id = e.user_id),
v2 AS (SELECT * FROM v1 WHERE NOT EXISTS (
         SELECT 1 FROM changes c WHERE c.op = 'delete' AND c.id = v1.id AND c.user_id = v1.user_id)
       UNION ALL SELECT id, user_id, date, category, amount, COALESCE(payment_mode, 'Cash'), COALESCE(notes, '')
       FROM changes WHERE op = 'insert')"""


@register("expense_versions", f"""WITH {_V1}
SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2""", ("exp_daily", "changes"))
def q_expense_versions(spark, sf):
    """Both versions after two commits, read from one store."""
    store = ledger_store(spark, sf)
    return store.read("expenses", 1).select(F.lit(1).alias("version"), "*").unionByName(
        store.read("expenses", 2).select(F.lit(2).alias("version"), "*"))


@register("expense_changes_between_versions", f"""WITH {_V1}
SELECT 'removed' AS change, * FROM (SELECT {COLS} FROM exp_daily EXCEPT ALL SELECT * FROM v2)
UNION ALL SELECT 'added', * FROM (SELECT * FROM v2 EXCEPT ALL SELECT {COLS} FROM exp_daily)""", ("exp_daily", "changes"))
def q_expense_changes(spark, sf):
    return ledger_store(spark, sf).changed("expenses", 0, 2)


@register("budget_versions", """
WITH nw AS (SELECT user_id, month, category, arg_max(budget_amount, seq) AS budget_amount
            FROM budget_changes GROUP BY 1, 2, 3)
SELECT 0 AS version, user_id, month, category, budget_amount FROM budgets
UNION ALL
SELECT 1, COALESCE(b.user_id, nw.user_id), COALESCE(b.month, nw.month), COALESCE(b.category, nw.category),
       COALESCE(nw.budget_amount, b.budget_amount)
FROM budgets b FULL OUTER JOIN nw ON b.user_id = nw.user_id AND b.month = nw.month AND b.category = nw.category""",
          ("budgets", "budget_changes"))
def q_budget_versions(spark, sf):
    """Budgets before and after the commit that also patched the expenses."""
    store = ledger_store(spark, sf)
    cols = [*L.BUDGET_KEY, "budget_amount"]
    return store.read("budgets", 0).select(F.lit(0).alias("version"), *cols).unionByName(
        store.read("budgets", 2).select(F.lit(1).alias("version"), *cols))


@register("purge_versions", """
SELECT 'expenses' AS tbl, version, COUNT(*) AS n_rows FROM (
  SELECT 0 AS version, user_id FROM exp_daily UNION ALL
  SELECT 1, user_id FROM exp_daily e WHERE NOT EXISTS (SELECT 1 FROM purge_users p WHERE p.user_id = e.user_id)) GROUP BY version
UNION ALL
SELECT 'budgets', version, COUNT(*) FROM (
  SELECT 0 AS version, user_id FROM budgets UNION ALL
  SELECT 1, user_id FROM budgets e WHERE NOT EXISTS (SELECT 1 FROM purge_users p WHERE p.user_id = e.user_id)) GROUP BY version""",
          ("exp_daily", "budgets", "purge_users"))
def q_purge_versions(spark, sf):
    """Users and what depends on them leave every table with one switch."""
    store = SnapshotStore.create(spark, f"{tables_root(spark)}/purge-{uuid.uuid4().hex}", {
        "expenses": Table(exp_daily(spark, sf), ["id"], 16), "budgets": Table(budgets(spark, sf), L.BUDGET_KEY, 16)})
    gone = Change(purge_users(spark, sf), L.purge_user_expenses, ["user_id"])
    store.commit({"expenses": gone, "budgets": gone})
    parts = [store.read(t, v).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("tbl"), F.lit(v).alias("version"), "n_rows")
             for t in ("expenses", "budgets") for v in (0, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
