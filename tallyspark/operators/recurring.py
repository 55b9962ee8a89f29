"""Recurring expenses (R1), by a fixed gap (``recurring_expenses``) or with
the period found (``recurring_patterns``).  By a fixed gap: the same (user, category, note) at least
``min_count`` times, every gap between consecutive dates within
[``min_gap``, ``max_gap``] days (monthly by default).

Rows are first reduced to distinct dates per group, so the window that
computes the gaps runs over at most one row per calendar day of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, money_sum


def recurring_expenses(df: DataFrame, min_count: int = 3, min_gap: int = 28,
                       max_gap: int = 31) -> DataFrame:
    keys = ["user_id", "category", "note"]
    d = (df.filter(F.col("date").isNotNull())
         .withColumn("note", F.coalesce(F.col("notes"), F.lit("")))
         .groupBy(*keys, "date").agg(money_sum("amount").alias("day_amount"),
                                     F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*keys).orderBy("date")
    d = d.withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    g = d.groupBy(*keys).agg(
        F.sum("n").alias("occurrences"),
        F.count(F.lit(1)).alias("n_dates"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        (F.sum(money("day_amount")).cast("double") / F.sum("n")).alias("avg_amount"))
    return g.filter((F.col("n_dates") >= min_count) & (F.col("min_gap") >= min_gap)
                    & (F.col("max_gap") <= max_gap))


class Period(NamedTuple):
    """A spacing of payments in days: ``lo``-``hi`` is on time, ``lo - slack``
    to ``hi + slack`` shifted; a payment two spacings on means one was missed."""
    name: str
    days: int
    lo: int
    hi: int
    slack: int


PERIODS = (Period("weekly", 7, 6, 8, 1), Period("fortnightly", 14, 13, 15, 2), Period("monthly", 30, 28, 31, 4),
           Period("quarterly", 91, 89, 92, 8), Period("yearly", 365, 364, 367, 10))
#: credit of a shifted payment and of a missed one whose next came
SHIFTED, MISSED = 0.75, 0.5


def recurring_patterns(df: DataFrame, periods: Sequence[Period] = PERIODS, min_count: int = 3,
                       min_score: float = 0.6) -> DataFrame:
    """R1 with the period found: (user, category, note) groups whose dates
    repeat weekly, every two weeks, monthly, quarterly or yearly.

    For each period, a date is followed on time, with a shift, after one miss
    or not at all; that is the autocorrelation of the day grid at the period
    (within its tolerance), read by range frames over a group's distinct dates
    instead of all pairs of them.  Dates whose next payment lies after the
    group's last date aren't judged; at least ``min_count - 1`` must be.  The
    score is the mean credit of the judged dates (1, ``SHIFTED``, ``MISSED``,
    0) above what dates as dense as the group's would hit by chance, scaled
    so that 1 is perfect: daily purchases are no weekly pattern.  The shortest
    period that scores ``min_score`` or more is the group's (its multiples
    repeat too, on fewer judged dates); groups without one are left out.  ``next_date`` is one period after the last date.

    Undated rows are ignored, a null note counts as empty, several payments
    of a day are one date.  A group's window holds a row for each calendar
    day at most."""
    keys = ["user_id", "category", "note"]
    d = (df.filter(F.col("date").isNotNull()).withColumn("note", F.coalesce(F.col("notes"), F.lit("")))
         .groupBy(*keys, "date").agg(money_sum("amount").alias("day_amount"), F.count(F.lit(1)).alias("n"))
         .withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date"))))
    group = Window.partitionBy(*keys)
    w = group.orderBy("day")
    d = d.withColumn("last", F.max("day").over(group))

    def follows(lo: int, hi: int):
        return F.count(F.lit(1)).over(w.rangeBetween(lo, hi)) > 0

    sums = []
    for p in periods:
        lo, hi = p.lo - p.slack, p.hi + p.slack
        d = d.withColumn(f"k_{p.name}", F.when(F.col("day") + lo > F.col("last"), None)
                         .when(follows(p.lo, p.hi), 1).when(follows(lo, hi), 2)
                         .when(follows(2 * lo, 2 * hi), 3).otherwise(0))
        sums += [F.count(F.when(F.col(f"k_{p.name}") == k, 1)).alias(f"{p.name}_{k}") for k in (1, 2, 3)]
        sums.append(F.count(f"k_{p.name}").alias(f"{p.name}_due"))
    g = d.groupBy(*keys).agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_dates"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.sum(money("day_amount")).cast("double") / F.sum("n")).alias("avg_amount"), *sums)
    span = F.datediff("last_date", "first_date")
    found = []
    for p in sorted(periods, key=lambda p: p.days):
        on, late, missed, due = (F.col(f"{p.name}_{k}") for k in (1, 2, 3, "due"))
        chance = (F.col("n_dates") - 1) * (p.hi - p.lo + 2 * p.slack + 1) / span
        credit = (on + late * F.lit(SHIFTED) + missed * F.lit(MISSED)) / due
        score = F.when((due >= min_count - 1) & (chance < 1), (credit - chance) / (1 - chance))
        found.append(F.when(score >= min_score, F.struct(
            score.alias("score"), F.lit(p.name).alias("period"),
            due.alias("n_due"), on.alias("n_on_time"), late.alias("n_shifted"), missed.alias("n_missed"),
            _step(p).alias("next_date"))))
    return (g.filter((F.col("n_dates") >= min_count) & (span > 0)).withColumn("best", F.coalesce(*found))
            .filter(F.col("best").isNotNull())
            .select(*keys, "occurrences", "n_dates", "first_date", "last_date", "avg_amount",
                    *[F.col(f"best.{c}") for c in ("period", "score", "n_due", "n_on_time", "n_shifted",
                                                   "n_missed", "next_date")]))


def _step(p: Period):
    """One period after the last date; months and years by the calendar."""
    months = {"monthly": 1, "quarterly": 3, "yearly": 12}.get(p.name)
    return F.add_months("last_date", months) if months else F.date_add("last_date", p.days)
