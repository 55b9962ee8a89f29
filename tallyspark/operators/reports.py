"""Spending reports (A1-A24, W1, W10, T1-T5): one plan for all users.

Conventions
- input: an expense frame ``(id, user_id, date, category, amount, ...)``;
- money sums are exact (DECIMAL) and order-independent, see ``functions.money``;
- ties are broken by the smallest key (pandas ``idxmax`` picks the first label);
- windows only run over *aggregated* rows (a user's days, months or
  categories), never over a user's raw transactions, so one very active user
  cannot make one huge window partition.  Per-user top-n over raw rows uses
  ``row_number <= n`` which Spark plans as a partial ``WindowGroupLimit``
  before the shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (half_even, is_weekend, iso_week, money, money_mean, money_sum,
                         month_key, py_round, weekday)
from ..session import materialize
from .skew import salted_join

USER = "user_id"


def _dated(df: DataFrame) -> DataFrame:
    """pandas ``groupby`` drops null keys; Spark keeps a null group."""
    return df.filter(F.col("date").isNotNull())


# --- A1-A6 ----------------------------------------------------------------

def daily_totals(df: DataFrame) -> DataFrame:
    """A1: (user_id, ds, y) — amount per user and day."""
    return (_dated(df).groupBy(USER, F.col("date").alias("ds"))
            .agg(money_sum("amount").alias("y")))


def monthly_totals(df: DataFrame) -> DataFrame:
    """A2: (user_id, month 'yyyy-MM', total)."""
    return (_dated(df).groupBy(USER, month_key("date").alias("month"))
            .agg(money_sum("amount").alias("total")))


def category_summary(df: DataFrame) -> DataFrame:
    """A3: sum, count and mean per user and category."""
    return (df.groupBy(USER, "category")
            .agg(money_sum("amount").alias("total"),
                 F.count("amount").alias("n"),
                 money_mean("amount").alias("mean")))


def category_analysis(df: DataFrame) -> DataFrame:
    """A5: rounded total/count/avg/min/max per category and share (1 decimal)
    of the user's sum of *rounded* totals."""
    per = (df.groupBy(USER, "category")
           .agg(half_even(money_sum("amount")).alias("total"),
                F.count("amount").alias("n"),
                half_even(money_mean("amount")).alias("average"),
                half_even(F.min("amount")).alias("min_amount"),
                half_even(F.max("amount")).alias("max_amount")))
    user_total = F.sum(money("total")).over(Window.partitionBy(USER)).cast("double")
    # a user whose total is 0 has no shares
    return per.withColumn("share_pct", half_even(F.try_divide("total", user_total) * 100, 1))


def month_category_summary(df: DataFrame) -> DataFrame:
    """Total, count, average per user x month x category, rounded to 2."""
    return (_dated(df).groupBy(USER, month_key("date").alias("month"), "category")
            .agg(half_even(money_sum("amount")).alias("total"),
                 F.count("amount").alias("n"),
                 half_even(money_mean("amount")).alias("average")))


# --- A7-A15 ---------------------------------------------------------------

def _first_max(key: str, value: str):
    """Key with the largest value; equal values -> smallest key."""
    return F.min_by(F.col(key), F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))


def _first_min(key: str, value: str):
    return F.min_by(F.col(key), F.struct(F.col(value).alias("v"), F.col(key).alias("k")))


def month_growth(df: DataFrame) -> DataFrame:
    """Growth % of the last observed month over the one before;
    0 with fewer than two months or a previous total <= 0."""
    return _growth(monthly_totals(df))


def _growth(m: DataFrame) -> DataFrame:
    """Growth of the last two rows of a (user, month, total) table."""
    w = Window.partitionBy(USER).orderBy(F.col("month").desc())
    top2 = m.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    g = top2.groupBy(USER).agg(
        F.max(F.when(F.col("rn") == 1, F.col("month"))).alias("last_month"),
        F.max(F.when(F.col("rn") == 1, F.col("total"))).alias("last_total"),
        F.max(F.when(F.col("rn") == 2, F.col("month"))).alias("prev_month"),
        F.max(F.when(F.col("rn") == 2, F.col("total"))).alias("prev_total"))
    growth = F.when(F.col("prev_total") > 0,
                    (F.col("last_total") - F.col("prev_total")) / F.col("prev_total") * 100
                    ).otherwise(F.lit(0.0))
    return g.withColumn("growth_pct", growth)


def insights(df: DataFrame) -> DataFrame:
    """The analytics summary, one row per user.

    One scan and one shuffle of the rows: they are pre-aggregated to (user,
    month, category, weekend) with exact DECIMAL sums; that table is written
    when the frame is built (one job), and the month, category and user
    figures are roll-ups of it.  The growth rate rounds as NumPy does, all
    other figures as Python does.  ``monthly_totals`` and ``category_totals``
    are the unrounded lists, one entry for each month and category of the user
    (in their order; rows without a category are in no category's total)."""
    d = _dated(df)
    wk = is_weekend("date")
    g = (d.groupBy(USER, month_key("date").alias("month"), "category", wk.alias("wk"))
         .agg(money_sum("amount").alias("s"), F.count("amount").alias("n")))
    # four roll-ups read it: materialise once rather than re-scan per branch
    g = materialize(g, "insights")
    m = g.groupBy(USER, "month").agg(money_sum("s").alias("total"))
    c = g.groupBy(USER, "category").agg(money_sum("s").alias("total"))
    months = m.groupBy(USER).agg(_first_max("month", "total").alias("highest_month"),
                                 F.max("total").alias("highest_amount"),
                                 _first_min("month", "total").alias("lowest_month"),
                                 F.min("total").alias("lowest_amount"),
                                 F.sort_array(F.collect_list(F.struct("month", "total"))).alias("monthly_totals"))
    named = F.when(F.col("category").isNotNull(), F.struct("category", "total"))
    cats = c.groupBy(USER).agg(_first_max("category", "total").alias("top_category"),
                               F.max("total").alias("top_category_amount"),
                               F.sort_array(F.collect_list(named)).alias("category_totals"))

    def side_mean(flag):
        sel = F.col("wk") == flag
        return py_round(F.coalesce(F.try_divide(money_sum(F.when(sel, F.col("s"))),
                                                F.sum(F.when(sel, F.col("n")))), F.lit(0.0)))

    base = g.groupBy(USER).agg(
        F.sum("n").alias("total_transactions"),
        py_round(F.try_divide(money_sum("s"), F.sum("n"))).alias("avg_transaction"),
        side_mean(True).alias("weekend_avg"), side_mean(False).alias("weekday_avg"))
    growth = _growth(m).select(USER, half_even("growth_pct").alias("growth_rate"))
    return (base.join(months, USER).join(cats, USER).join(growth, USER)
            .select(USER, "highest_month", py_round("highest_amount").alias("highest_amount"),
                    "lowest_month", py_round("lowest_amount").alias("lowest_amount"),
                    "top_category", py_round("top_category_amount").alias("top_category_amount"),
                    "growth_rate", "weekend_avg", "weekday_avg", "total_transactions",
                    "avg_transaction", "monthly_totals", "category_totals"))


def insight_lists(summary: DataFrame) -> DataFrame:
    """(user_id, list, position, name, total): the two lists of ``insights``
    as rows, positions from 0 in the order of the list."""
    def rows(col: str, key: str) -> DataFrame:
        return (summary.select(USER, F.posexplode(col).alias("position", "e"))
                .select(USER, F.lit(col).alias("list"), "position", F.col(f"e.{key}").alias("name"), "e.total"))
    return rows("monthly_totals", "month").unionByName(rows("category_totals", "category"))


def dashboard_kpis(df: DataFrame, start: str, end: str) -> DataFrame:
    """KPIs of the date window [start, end] (inclusive) per user."""
    days = max((date.fromisoformat(end) - date.fromisoformat(start)).days, 1)
    w = df.filter((F.col("date") >= F.lit(start).cast("date"))
                  & (F.col("date") <= F.lit(end).cast("date")))
    # one scan: the user's figures roll up the category rows
    per = w.groupBy(USER, "category").agg(money_sum("amount").alias("total"), F.count("amount").alias("n"))
    return (per.groupBy(USER)
            .agg(_first_max("category", "total").alias("top_category"),
                 F.max("total").alias("top_category_amount"),
                 money_sum("total").alias("_total"), F.sum("n").alias("n_transactions"))
            .withColumnRenamed("_total", "total")
            .withColumn("avg_daily", F.col("total") / F.lit(float(days)))
            .withColumn("avg_per_transaction",
                        F.col("total") / F.greatest(F.col("n_transactions"), F.lit(1)))
            .select(USER, "total", "avg_daily", "n_transactions", "avg_per_transaction",
                    "top_category", "top_category_amount"))


def month_over_month(df: DataFrame, as_of: str) -> DataFrame:
    """A10: this calendar month (from its 1st, no upper bound, as the
    reference) vs the previous calendar month, as of a given date."""
    this_start = F.trunc(F.lit(as_of).cast("date"), "month")
    last_start = F.add_months(this_start, -1)
    this_sum = money_sum(F.when(F.col("date") >= this_start, F.col("amount")))
    last_sum = money_sum(F.when((F.col("date") >= last_start) & (F.col("date") < this_start),
                                F.col("amount")))
    g = df.groupBy(USER).agg(F.coalesce(this_sum, F.lit(0.0)).alias("this_month"),
                             F.coalesce(last_sum, F.lit(0.0)).alias("last_month"))
    return g.withColumn(
        "mom_change_pct",
        F.when(F.col("last_month") > 0,
               (F.col("this_month") - F.col("last_month")) / F.col("last_month") * 100)
        .otherwise(F.lit(0.0)))


def weekend_weekday_split(df: DataFrame) -> DataFrame:
    """Total and per-transaction mean for weekend / weekday."""
    return (_dated(df).groupBy(USER, is_weekend("date").alias("is_weekend"))
            .agg(money_sum("amount").alias("total"),
                 money_mean("amount").alias("avg_per_transaction"),
                 F.count("amount").alias("n")))


def weekday_means(df: DataFrame) -> DataFrame:
    """Mean amount per weekday, all 7 weekdays per user (missing -> NULL).

    One aggregation with 7 conditional aggregates, then ``stack`` — no join
    against a weekday dimension."""
    wd = weekday("date")
    aggs = []
    for i in range(7):
        hit = F.when(wd == i, F.col("amount"))
        aggs.append(F.try_divide(money_sum(hit), F.count(hit)).alias(f"m{i}"))
    g = _dated(df).groupBy(USER).agg(*aggs)
    stack = "stack(7, " + ", ".join(f"{i}, m{i}" for i in range(7)) + ") AS (weekday, mean_amount)"
    return g.selectExpr(USER, stack)


def history_totals(df: DataFrame) -> DataFrame:
    """Total, count and mean of a (filtered) history."""
    return df.groupBy(USER).agg(money_sum("amount").alias("total"),
                                F.count("amount").alias("n"),
                                money_mean("amount").alias("mean"))


def account_statistics(df: DataFrame) -> DataFrame:
    """Profile statistics per user."""
    return df.groupBy(USER).agg(
        money_sum("amount").alias("total_spent"),
        F.count("amount").alias("total_transactions"),
        F.min("date").alias("first_expense"),
        F.max("date").alias("last_expense"),
        money_mean("amount").alias("avg_transaction"),
        F.countDistinct("category").alias("categories_used"))


def expense_summary(df: DataFrame) -> DataFrame:
    """Export summary with the top category and the date range text."""
    # one scan: the user's figures roll up the category rows
    per = df.groupBy(USER, "category").agg(
        money_sum("amount").alias("total"), F.count("amount").alias("n"), F.max("amount").alias("hi"),
        F.min("amount").alias("lo"), F.min("date").alias("first"), F.max("date").alias("last"))
    return per.groupBy(USER).agg(
        money_sum("total").alias("total_expenses"),
        F.sum("n").alias("total_transactions"),
        F.try_divide(money_sum("total"), F.sum("n")).alias("avg_transaction"),
        F.max("hi").alias("max_transaction"),
        F.min("lo").alias("min_transaction"),
        F.concat(F.min("first").cast("string"), F.lit(" to "),
                 F.max("last").cast("string")).alias("date_range"),
        _first_max("category", "total").alias("top_category"))


# --- A16-A24 --------------------------------------------------------------

def value_counts(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Frequency of each value of each column, most frequent first
    (ties: smallest value).  Long format: (column, value, n, rank).

    One scan: the columns are unpivoted with ``stack`` and counted in a
    single group-by; the top-n per column is a partial ``WindowGroupLimit``."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, value)")
    out = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if not top:
        # full listing: a range-partitioned sort, not one window per column
        return out.orderBy("column", F.col("n").desc(), F.col("value").asc_nulls_last())
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def note_category_counts(df: DataFrame) -> DataFrame:
    """Rows per (notes, category)."""
    return df.groupBy("notes", "category").agg(F.count(F.lit(1)).alias("n"))


def note_conflicts(df: DataFrame, only_conflicts: bool = True) -> DataFrame:
    """Distinct categories per note (those with more than one)."""
    out = df.groupBy("notes").agg(F.countDistinct("category").alias("n_categories"))
    return out.filter(F.col("n_categories") > 1) if only_conflicts else out


def dominant_category(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A4: most frequent category per note (ties: smallest category).

    The window runs over (note, category) counts, at most one row per
    category of a note — bounded however large a note's group is."""
    counts = note_category_counts(df) if counts is None else counts
    w = Window.partitionBy("notes").orderBy(F.col("n").desc(), F.col("category").asc())
    return (counts.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select("notes", F.col("category").alias("dominant_category"), "n"))


def distinct_notes(df: DataFrame) -> DataFrame:
    """Number of distinct notes (nulls not counted)."""
    return df.agg(F.countDistinct("notes").alias("distinct_notes"))


def describe_amount(df: DataFrame, col: str = "amount") -> DataFrame:
    """Count, mean, std, min, quartiles (linear interpolation), max.

    Quartiles are exact without gathering the column anywhere: the values
    are reduced to a (value, count) histogram, approximate split points cut
    it into ranges, per-range counts give each range's starting rank, and
    only the few ranges holding a wanted rank are ordered — inside their own
    partitions."""
    from .quantiles import exact_quantiles
    x = df.select(F.col(col).alias("x")).filter(F.col("x").isNotNull())
    stats = x.agg(F.count("x").alias("count"),
                  money_mean("x").alias("mean"),
                  half_even(F.stddev_samp("x"), 6).alias("std"),
                  F.min("x").alias("min"),
                  F.max("x").alias("max"))
    q = exact_quantiles(x, "x", [0.25, 0.5, 0.75], names=["q25", "q50", "q75"])
    # attach the one-row quartile frame as one scalar struct
    qs = q.select(F.struct("q25", "q50", "q75")).scalar()
    return stats.select("*", *[qs[c].alias(c) for c in ("q25", "q50", "q75")])


def describe_by_key(df: DataFrame, keys: list[str], col: str = "amount") -> DataFrame:
    """A19 for every key: count, mean, std, min, quartiles, max of its values
    (keys without a value are left out).  Quartiles are exact, also for a key
    with a large share of all rows."""
    from .quantiles import quantiles_by_key
    x = df.select(*keys, F.col(col).alias("x")).filter(F.col("x").isNotNull())
    stats = x.groupBy(F.struct(*keys).alias("k")).agg(
        F.count("x").alias("count"), money_mean("x").alias("mean"), half_even(F.stddev_samp("x"), 4).alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantiles_by_key(x, keys, "x", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    q = q.select(F.struct(*keys).alias("k"), "q25", "q50", "q75")
    return stats.join(q, "k").select(*[F.col("k")[k].alias(k) for k in keys], "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def null_profile(df: DataFrame) -> DataFrame:
    """Non-null count and type of every column, one pass."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)],
                 F.count(F.lit(1)).alias("rows"))
    types = dict(df.dtypes)
    pairs = ", ".join(f"'{c}', '{types[c]}', c{i}" for i, c in enumerate(df.columns))
    return row.selectExpr(
        f"stack({len(df.columns)}, {pairs}) AS (column_name, dtype, non_null)", "rows")


def weekly_heatmap(df: DataFrame, iso_year: bool = False) -> DataFrame:
    """Per user and ISO week number, the sum of each weekday (Mon..Sun
    columns, missing 0).  The same week number of different years merges,
    as in the reference (Q10); ``iso_year`` keeps the years apart."""
    wd = weekday("date")
    aggs = [F.coalesce(money_sum(F.when(wd == i, F.col("amount"))), F.lit(0.0)).alias(n)
            for i, n in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"])]
    keys = [USER, iso_week("date").alias("week")]
    if iso_year:
        keys.insert(1, F.expr("extract(YEAROFWEEK FROM date)").alias("iso_year"))
    return _dated(df).groupBy(*keys).agg(*aggs)


def amount_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal-width bins between each user's min and
    max (max falls in the last bin).  Only non-empty bins are returned."""
    x = df.filter(F.col("amount").isNotNull())
    rng = x.groupBy(USER).agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"),
                              F.count(F.lit(1)).alias("_n"))
    j = salted_join(x.select(USER, "id", "amount"), rng.drop("_n"), [USER],
                    salt_from=["id"], counts=rng.select(USER, "_n"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0,
               F.least(F.floor((F.col("amount") - F.col("lo")) / width * bins) + 1,
                       F.lit(bins))).otherwise(F.lit(1)).cast("int")
    return (j.withColumn("bin", b)
            .groupBy(USER, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / bins)
            .drop("lo", "hi"))


def _ranked_categories(df: DataFrame) -> DataFrame:
    tot = df.groupBy(USER, "category").agg(money_sum("amount").alias("total"))
    w = Window.partitionBy(USER).orderBy(F.col("total").desc(), F.col("category").asc())
    return tot.withColumn("rank", F.row_number().over(w))


def category_breakdown(df: DataFrame, top: int = 8) -> DataFrame:
    """Top ``top`` categories per user and their share of those shown."""
    r = _ranked_categories(df).filter(F.col("rank") <= top)
    shown = F.sum(money("total")).over(Window.partitionBy(USER)).cast("double")
    return r.withColumn("share_pct", F.try_divide("total", shown) * 100)


def top_categories(df: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` largest category totals per user (rank 1 = largest)."""
    return _ranked_categories(df).filter(F.col("rank") <= top)


def category_trend(df: DataFrame, top: int = 5) -> DataFrame:
    """Monthly sums of each user's ``top`` categories by total."""
    # one scan to (user, category, month); undated rows count for the rank only
    per = df.groupBy(USER, "category", month_key("date").alias("month")).agg(money_sum("amount").alias("total"))
    by_category = Window.partitionBy(USER, "category")
    ranked = (per.withColumn("_all", F.sum(money("total")).over(by_category))
              .withColumn("_rank", F.dense_rank().over(
                  Window.partitionBy(USER).orderBy(F.col("_all").desc(), F.col("category").asc()))))
    return (ranked.filter((F.col("_rank") <= top) & F.col("month").isNotNull())
            .select(USER, "category", "month", "total"))


def daily_moving_average(df: DataFrame, window: int = 7) -> DataFrame:
    """``window``-row mean of daily totals (NULL until ``window`` rows);
    only for users with more than ``window`` days."""
    d = daily_totals(df)
    w = Window.partitionBy(USER).orderBy("ds").rowsBetween(-(window - 1), 0)
    n_all = F.count(F.lit(1)).over(Window.partitionBy(USER))
    ma = F.when(F.count("y").over(w) == window,
                F.sum(money("y")).over(w).cast("double") / window)
    return (d.withColumn("_n", n_all).filter(F.col("_n") > window)
            .withColumn(f"ma{window}", ma).drop("_n"))


# --- T1-T5 ----------------------------------------------------------------

def recent_transactions(df: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` newest expenses per user (ties: larger id first)."""
    w = Window.partitionBy(USER).orderBy(F.col("date").desc(), F.col("id").desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def largest_expenses(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest amounts overall (ties: smaller id first)."""
    return df.orderBy(F.col("amount").desc(), F.col("id").asc()).limit(n)


def sorted_history(df: DataFrame, by: str = "date", ascending: bool = False) -> DataFrame:
    """T4: history sorted by date or amount (range-partitioned sort; a very
    active user spreads over several partitions because the id breaks ties)."""
    key = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(F.col(USER), key, F.col("id").asc())


def random_sample(df: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """T5: ``n`` repeatable pseudo-random rows: smallest md5 of seed and id."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("id").cast("string"))),
                      F.col("id")).limit(n)
