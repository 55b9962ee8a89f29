"""Joins of raw rows to a one-row-per-key table when a key may be hot.

A key can hold a large share of all rows (one note, one user, one token).
A plain shuffle join sends all of that key's rows to one task.  Here the
hot keys are found from the per-key counts (a map-side reduced
aggregation): every key above ``min_rows`` rows, however many there are,
with as many sub-keys as its rows need at ``target_rows`` for each.  A hot
key's rows are spread over its sub-keys by a hash of the row, and the
table's row for that key is copied once per sub-key; every other key joins
unchanged (sub-key 0).  The list of hot keys joins like any other table: the
planner broadcasts it if its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MIN_ROWS = 1_000_000
TARGET_ROWS = 1_000_000
# the same settings can come from the session, e.g.
#   spark.conf.set("tallyspark.skew.minRows", "5000000")
CONF = {"minRows": "MIN_ROWS", "targetRows": "TARGET_ROWS"}


def _setting(df: DataFrame, name: str) -> int:
    return int(df.sparkSession.conf.get(f"tallyspark.skew.{name}", str(globals()[CONF[name]])))


def hot_keys(counts: DataFrame, key: list[str], n_col: str = "_n", min_rows: int | None = None,
             target_rows: int | None = None) -> DataFrame:
    """(key, _salts) for every key that holds more than ``min_rows`` rows."""
    min_rows = _setting(counts, "minRows") if min_rows is None else min_rows
    target = target_rows or _setting(counts, "targetRows")
    return (counts.filter(F.col(n_col) > min_rows)
            .select(*key, F.ceil(F.col(n_col) / F.lit(target)).cast("int").alias("_salts")))


def salted_join(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner",
                salt_from: list[str] | None = None, counts: DataFrame | None = None,
                n_col: str = "_n", min_rows: int | None = None,
                target_rows: int | None = None, written: bool = False) -> DataFrame:
    """``rows`` joined to ``table`` (unique on ``key``) with hot keys split.

    ``counts`` (key, n_col) may be given when the caller already has the
    rows per key; otherwise it is computed (partial aggregation).  The
    sub-key is a hash of ``salt_from`` (default: all columns), so a task that
    runs again places its rows alike.  ``written``: the hot keys are written
    at once, so that the planner knows how few there are and does not shuffle
    the rows to find them (for counts that are cheap to read again)."""
    if counts is None:
        counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias(n_col))
    hot = hot_keys(counts, key, n_col, min_rows, target_rows)
    if written:
        hot = materialize(hot, "hot")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (salt_from or rows.columns)]), F.col("_salts"))
    r = (rows.join(hot, key, "left")
         .withColumn("_salt", F.coalesce(spread, F.lit(0)).cast("int")).drop("_salts"))
    t = (table.join(hot, key, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
         .drop("_salts"))
    return r.join(t, key + ["_salt"], how).drop("_salt")
