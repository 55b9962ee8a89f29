"""Versioned tables: pinned readers, one switch, writers that die or collide."""

import os
import subprocess
import sys
import tempfile

import pytest

from tallyspark.operators.ledger import append_expenses, apply_expense_updates, delete_expenses, purge_user_expenses, upsert_budgets
from tallyspark.operators.snapshots import Change, ConstraintViolation, SnapshotStore, Table, VersionConflict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EXP = "id long, user_id long, date date, category string, amount double, payment_mode string, notes string"
PATCH = EXP + ", seq int"


def expenses(spark, n=40):
    return spark.range(n).selectExpr("id", "id % 4 AS user_id", "DATE '2024-01-01' AS date", "'Food' AS category",
                                     "CAST(id AS DOUBLE) AS amount", "'Cash' AS payment_mode", "'' AS notes")


def patch(spark, *rows):
    return spark.createDataFrame([(i, u, None, None, a, None, None, s) for i, u, a, s in rows], PATCH)


def store(spark, **kw):
    path = f"{tempfile.mkdtemp(prefix='snap-', dir='/tmp')}/store"
    return SnapshotStore.create(spark, path, {
        "expenses": Table(expenses(spark), ["id"], 8, True, ("id", "user_id"), **kw),
        "budgets": Table(spark.createDataFrame([(1, "2024-01", "Food", 5.0)], "user_id long, month string, category string, budget_amount double"),
                         ["user_id", "month", "category"], 4, True)})


def amounts(df):
    return {r["id"]: r["amount"] for r in df.collect()}


def test_versions_stay_as_they_were_and_untouched_buckets_are_shared(spark):
    s = store(spark)
    pinned = s.read("expenses")
    before = amounts(pinned)
    assert s.commit({"expenses": Change(patch(spark, (3, 3, 100.0, 1), (3, 3, 101.0, 2), (5, 0, 9.0, 1)), apply_expense_updates, ["id", "user_id"])}) == 1
    assert s.commit({"expenses": Change(patch(spark, (7, 3, None, 1)), delete_expenses, ["id", "user_id"])}) == 2
    assert s.versions() == [0, 1, 2]
    assert amounts(pinned) == amounts(s.read("expenses", 0)) == before
    assert amounts(s.read("expenses", 1)) == before | {3: 101.0}  # id 5 is not user 0's
    assert amounts(s.read("expenses")) == {k: v for k, v in (before | {3: 101.0}).items() if k != 7}
    assert len(s.rewritten("expenses", 0, 1)) <= 2 and len(s.rewritten("expenses", 1, 2)) == 1
    assert s.rewritten("budgets", 0, 2) == []
    diff = sorted((r["change"], r["id"], r["amount"]) for r in s.changed("expenses", 0, 2).collect())
    assert diff == [("added", 3, 101.0), ("removed", 3, 3.0), ("removed", 7, 7.0)]


def test_two_tables_switch_together_and_users_are_found_in_any_bucket(spark):
    s = store(spark)
    users = spark.createDataFrame([(1,), (99,)], "user_id long")
    gone = Change(users, purge_user_expenses, ["user_id"])
    s.commit({"expenses": gone, "budgets": gone})
    assert s.read("budgets").count() == 0 and s.read("budgets", 0).count() == 1
    assert {r["user_id"] for r in s.read("expenses").collect()} == {0, 2, 3}
    new = spark.createDataFrame([(2, "2024-02", "Food", 7.0, 1)], "user_id long, month string, category string, budget_amount double, seq int")
    s.commit({"budgets": Change(new, upsert_budgets)})
    assert s.read("budgets").collect()[0]["budget_amount"] == 7.0
    assert s.commit({"budgets": Change(new.limit(0), upsert_budgets)}) == 3  # nothing touched, still a version


def test_only_one_writer_gets_a_version(spark):
    s = store(spark)
    change = {"expenses": Change(patch(spark, (3, 3, 1.5, 1)), apply_expense_updates, ["id", "user_id"])}
    other = {"expenses": Change(patch(spark, (3, 3, 2.5, 1)), apply_expense_updates, ["id", "user_id"])}
    with pytest.raises(VersionConflict):
        s.commit(change, before_switch=lambda: SnapshotStore(spark, s.path).commit(other))
    assert s.versions() == [0, 1] and amounts(s.read("expenses"))[3] == 2.5
    assert s.commit(change) == 2 and amounts(s.read("expenses"))[3] == 1.5
    assert len(s.remove_strays()) == 1 and amounts(s.read("expenses", 1))[3] == 2.5


def test_rules_hold_before_anything_is_visible(spark):
    s = store(spark)
    twice = spark.createDataFrame([(3, 3, None, "Food", 1.0, None, None)], EXP)
    with pytest.raises(ConstraintViolation, match="repeated"):
        s.commit({"expenses": Change(twice, append_expenses)})
    nobody = spark.createDataFrame([(100, None, None, "Food", 1.0, None, None)], EXP)
    with pytest.raises(ConstraintViolation, match="lack"):
        s.commit({"expenses": Change(nobody, append_expenses)})
    move = Change(patch(spark, (3, 3, 1.0, 1)), lambda base, _: base.selectExpr("id + 1 AS id", *[c for c in base.columns if c != "id"]))
    with pytest.raises(ConstraintViolation, match="other buckets|repeated"):
        s.commit({"expenses": move})
    assert s.versions() == [0] and s.read("expenses").count() == 40


def test_expire_keeps_what_later_versions_share(spark):
    s = store(spark)
    for k in range(3):
        s.commit({"expenses": Change(patch(spark, (k, k, 50.0 + k, 1)), apply_expense_updates, ["id", "user_id"])})
    want = amounts(s.read("expenses"))
    assert s.expire(keep=1) == [0, 1, 2] and s.versions() == [3]
    assert amounts(s.read("expenses")) == want and s.read("budgets").count() == 1


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from tallyspark.operators.ledger import apply_expense_updates
from tallyspark.operators.snapshots import Change, SnapshotStore
from tallyspark.session import build_session
spark = build_session("killed", cores=2, shuffle_partitions=4)
rows = spark.createDataFrame([(3, 3, None, None, 77.0, None, None, 1)], {schema!r})
SnapshotStore(spark, {path!r}).commit({{"expenses": Change(rows, apply_expense_updates, ["id", "user_id"])}},
                                      before_switch=lambda: os._exit(9))
"""


def test_a_writer_killed_before_the_switch_changes_nothing(spark):
    s = store(spark)
    before = amounts(s.read("expenses"))
    files = {f for _, _, names in os.walk(s.path) for f in names}
    done = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, schema=PATCH, path=s.path)], capture_output=True, timeout=240)
    assert done.returncode == 9, done.stderr.decode()[-2000:]
    assert {f for _, _, names in os.walk(s.path) for f in names} > files  # it had written its rows
    assert s.versions() == [0] and amounts(s.read("expenses")) == before
    s.commit({"expenses": Change(patch(spark, (3, 3, 78.0, 1)), apply_expense_updates, ["id", "user_id"])})
    assert amounts(s.read("expenses")) == before | {3: 78.0}
    assert len(s.remove_strays()) == 1 and s.read("expenses", 0).count() == 40
