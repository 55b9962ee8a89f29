"""Ledger changes as batches against snapshots.

The reference changes one row per request; here a change set is a
DataFrame applied to a whole snapshot.  "Latest change per key" is an
aggregate (``max_by`` on the sequence number), so a key with very many
changes is reduced map-side before any shuffle.  Results are new snapshots;
``snapshots.SnapshotStore`` keeps them as versions, rewrites only the buckets
a change set touches and switches with one rename.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPENSE_COLS = ["id", "user_id", "date", "category", "amount", "payment_mode", "notes"]
EXPENSE_KEY = ["id", "user_id"]
BUDGET_KEY = ["user_id", "month", "category"]
DEFAULTS = {"payment_mode": "Cash", "notes": ""}


def _latest(changes: DataFrame, key: list[str], cols: list[str], seq: str = "seq") -> DataFrame:
    """Last change per key by ``seq`` (map-side reducible)."""
    packed = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(seq)).alias("_v")
    return changes.groupBy(*key).agg(packed).select(*key, *[F.col(f"_v.{c}").alias(c) for c in cols])


def append_expenses(base: DataFrame, new: DataFrame) -> DataFrame:
    """L1: insert rows; missing payment mode -> 'Cash', missing notes -> ''."""
    ins = new.select(*[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS
                       else F.col(c) for c in EXPENSE_COLS])
    return base.select(*EXPENSE_COLS).unionByName(ins)


def _latest_fields(changes: DataFrame, key: list[str], cols: list[str], seq: str = "seq") -> DataFrame:
    """Per key and field the last value that is not null: patches of one key
    add up, as if applied one after the other."""
    return changes.groupBy(*key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def apply_expense_updates(base: DataFrame, patches: DataFrame, overwrite: bool = False,
                          key: list[str] | None = None) -> DataFrame:
    """L2: apply all patches in the order of ``seq``.  Patch semantics: a
    NULL field keeps the value it had; ``overwrite`` replaces every field by
    the last change.  Rows match on (id, user_id), so only rows owned by the
    patch's user change, or on ``key=["id"]`` alone (the local store)."""
    key = key or EXPENSE_KEY
    fields = [c for c in EXPENSE_COLS if c not in EXPENSE_KEY]
    p = _latest(patches, key, fields) if overwrite else _latest_fields(patches, key, fields)
    p = p.select(*key, *[F.col(c).alias(f"_p_{c}") for c in fields],
                 F.lit(True).alias("_hit"))
    j = base.select(*EXPENSE_COLS).join(p, key, "left")
    out = []
    for c in fields:
        if overwrite:
            out.append(F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c))
    return j.select(*EXPENSE_KEY, *out).select(*EXPENSE_COLS)


def delete_expenses(base: DataFrame, deletes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """L3: drop rows whose (id, owner) is in the delete set; ``key=["id"]``
    matches on the id alone (the local store)."""
    key = key or EXPENSE_KEY
    return base.join(deletes.select(*key).distinct(), key, "left_anti")


def purge_user_expenses(base: DataFrame, users: DataFrame) -> DataFrame:
    """L4: drop every expense of the given users.  The planner broadcasts the
    ids if they are few; otherwise AQE splits a very active user's rows."""
    return base.join(users.select("user_id").distinct(), "user_id", "left_anti").select(*base.columns)


def purge_user_cascade(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Deleting users deletes their rows from every dependent table."""
    gone = users.select("user_id").distinct()
    return {name: t.join(gone, "user_id", "left_anti").select(*t.columns) for name, t in tables.items()}


def upsert_budgets(budgets: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert or overwrite ``budget_amount`` on (user_id, month, category);
    among duplicate incoming rows the highest ``seq`` wins."""
    new = _latest(incoming, BUDGET_KEY, ["budget_amount"], seq).withColumnRenamed(
        "budget_amount", "_new")
    j = budgets.select(*BUDGET_KEY, "budget_amount").join(new, BUDGET_KEY, "full_outer")
    return j.select(*BUDGET_KEY, F.coalesce(F.col("_new"), F.col("budget_amount"))
                    .alias("budget_amount"))


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def check_required_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL count per required column, one pass, long format."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, null_count)")


def check_orphans(df: DataFrame, users: DataFrame, fk: str = "user_id") -> DataFrame:
    """Rows whose foreign key has no user."""
    return df.join(users.select(F.col("id").alias(fk)).distinct(), fk, "left_anti").select(*df.columns)
