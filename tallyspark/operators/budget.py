"""Budget checks (J2, G1-G3, C10) for every user and month at once.

Spend is aggregated to (user, month, category) before it meets the budget
table, so the joins are between two aggregated tables; a month's spend is
limited to that month (the reference counts future-dated rows, see Q7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money_sum, month_key, safe_pct, status_band
from ..schema import ALERT_SHARE, OVERALL

KEY = ["user_id", "month", "category"]


def category_spend(expenses: DataFrame) -> DataFrame:
    return (expenses.filter(F.col("date").isNotNull())
            .groupBy("user_id", month_key("date").alias("month"), "category")
            .agg(money_sum("amount").alias("spent")))


def month_spend(cat_spend: DataFrame) -> DataFrame:
    return (cat_spend.groupBy("user_id", "month")
            .agg(money_sum("spent").alias("spent")))


def budget_vs_actual(budgets: DataFrame, expenses: DataFrame) -> DataFrame:
    """Each category budget with its month's spend (0 if none)."""
    cats = budgets.filter(F.col("category") != OVERALL)
    return (cats.join(category_spend(expenses), KEY, "left")
            .withColumn("spent", F.coalesce(F.col("spent"), F.lit(0.0))))


def _capped_pct(spent, limit):
    return F.when(limit > 0, F.least(spent / limit * 100, F.lit(100.0))).otherwise(F.lit(0.0))


def budget_overall(budgets: DataFrame, expenses: DataFrame) -> DataFrame:
    """G1: month spend vs the Overall budget: percent capped at 100 (0 when
    the limit is <= 0), over at >= 100 %, amount over / remaining."""
    ov = budgets.filter(F.col("category") == OVERALL).select("user_id", "month", "budget_amount")
    j = (ov.join(month_spend(category_spend(expenses)), ["user_id", "month"], "left")
         .withColumn("spent", F.coalesce(F.col("spent"), F.lit(0.0))))
    pct = _capped_pct(F.col("spent"), F.col("budget_amount"))
    over = pct >= 100
    return j.select(
        "user_id", "month", "budget_amount", "spent", pct.alias("pct"),
        status_band(pct).alias("band"), over.alias("over_budget"),
        F.when(over, F.col("spent") - F.col("budget_amount")).alias("over_by"),
        F.when(~over, F.col("budget_amount") - F.col("spent")).alias("remaining"))


def budget_by_category(budgets: DataFrame, expenses: DataFrame) -> DataFrame:
    """Per category budget: capped percent, band, remaining (may be
    negative) and over flag (remaining < 0)."""
    j = budget_vs_actual(budgets, expenses)
    pct = _capped_pct(F.col("spent"), F.col("budget_amount"))
    remaining = F.col("budget_amount") - F.col("spent")
    return j.select(*KEY, "budget_amount", "spent", pct.alias("pct"),
                    status_band(pct).alias("band"), remaining.alias("remaining"),
                    (remaining < 0).alias("over_budget"))


def budget_alerts(budgets: DataFrame, expenses: DataFrame, share: float = ALERT_SHARE) -> DataFrame:
    """Budgets (Overall included) whose spend exceeds ``share`` of the
    limit; uncapped percent (NULL for a zero limit, still 'Over Budget')."""
    # one scan: each category row counts for its category and for Overall
    spend = (category_spend(expenses)
             .select("user_id", "month", F.explode(F.array("category", F.lit(OVERALL))).alias("category"), "spent")
             .groupBy(*KEY).agg(money_sum("spent").alias("spent")))
    j = budgets.join(spend, KEY, "inner")
    pct = safe_pct(F.col("spent"), F.col("budget_amount"))
    return (j.filter(F.col("spent") > F.col("budget_amount") * share)
            .select(*KEY, "budget_amount", "spent", pct.alias("pct"),
                    F.when(F.coalesce(pct >= 100, F.lit(True)), F.lit("Over Budget"))
                    .otherwise(F.lit("Approaching Limit")).alias("alert")))
