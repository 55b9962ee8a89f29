"""Input tables and the expense-shaped views over the driver's test tables.

Each view is a plain projection (plus one DISTINCT for budgets) so Catalyst
prunes columns and pushes filters straight into the Parquet scan.  The same
views exist as SQL text (``VIEW_SQL``) for the DuckDB oracle; where the two
dialects agree the select list is literally shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import month_key

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- shared select lists (valid Spark SQL and DuckDB SQL) -------------------

_PAYMENT_BY_ID = ("CASE id % 5 WHEN 0 THEN 'Cash' WHEN 1 THEN 'UPI' WHEN 2 THEN 'Credit Card' "
                  "WHEN 3 THEN 'Debit Card' ELSE 'EMI' END")

EXP_DAILY_SELECT = [
    "event_id AS id",
    "user_id",
    "CAST(ts AS DATE) AS date",
    "event_type AS category",
    "value AS amount",
    _PAYMENT_BY_ID.replace("id % 5", "event_id % 5") + " AS payment_mode",
    "props AS notes",
]

EXP_MONTHLY_SELECT = [
    "o_orderkey AS id",
    "o_custkey AS user_id",
    "CAST(o_orderdate AS DATE) AS date",
    "o_orderpriority AS category",
    "o_totalprice / 10 AS amount",  # order prices scaled so that the outlier cap removes outliers only
    "o_orderstatus AS payment_mode",
    "CAST(NULL AS STRING) AS notes",
]

SUBSCRIPTIONS_SELECT = [
    "o_orderkey AS id",
    "o_custkey AS user_id",
    "make_date(year(o_orderdate), month(o_orderdate), CAST(o_custkey % 28 + 1 AS INT)) AS date",
    "CAST(year(o_orderdate) AS STRING) AS category",
    "o_totalprice / 10 AS amount",
    "o_orderstatus AS payment_mode",
    "CAST(NULL AS STRING) AS notes",
]

USERS_SELECT = ["c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"]

# Dirty raw transactions derived from exp_daily (rules in FIXTURES.md);
# the first rule listed for a column wins.
_DMY = ("concat(lpad(CAST(day(date) AS STRING), 2, '0'), '/', "
        "lpad(CAST(month(date) AS STRING), 2, '0'), '/', CAST(year(date) AS STRING))")
RAW_SELECT = [
    "id",
    "user_id",
    f"CASE WHEN id % 113 = 0 THEN 'not a date' WHEN id % 23 = 0 THEN {_DMY} "
    "ELSE CAST(date AS STRING) END AS date_s",
    "CASE WHEN id % 7 = 0 THEN (CASE id % 6 WHEN 0 THEN 'foodd' WHEN 1 THEN 'rnt' "
    "WHEN 2 THEN 'utilties' WHEN 3 THEN 'traval' WHEN 4 THEN 'helth' ELSE 'edu' END) "
    "WHEN id % 11 = 0 THEN upper(category) WHEN id % 13 = 0 THEN NULL "
    "ELSE category END AS category_s",
    "CASE WHEN id % 97 = 0 THEN 'abc' WHEN id % 101 = 0 THEN '999999' "
    "WHEN id % 103 = 0 THEN '999999999' WHEN id % 107 = 0 THEN '-5' "
    "WHEN id % 109 = 0 THEN '0' ELSE CAST(amount AS STRING) END AS amount_s",
    "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN (CASE id % 7 WHEN 0 THEN '!!!' "
    "WHEN 1 THEN '...' WHEN 2 THEN 'unknown' WHEN 3 THEN 'asdfgh' WHEN 4 THEN 'test' "
    "WHEN 5 THEN 'xyz123' ELSE 'misc' END) WHEN id % 29 = 0 THEN 'Petrol' "
    "WHEN id % 31 = 0 THEN 'Coffee' WHEN id % 37 = 0 THEN 'Uber ride' "
    "ELSE notes END AS notes_s",
    "CASE WHEN id % 10 = 0 THEN 'Income' ELSE 'Expense' END AS type_s",
    "CASE id % 4 WHEN 0 THEN 'csh' WHEN 1 THEN 'Upi' WHEN 2 THEN 'CRD' "
    "ELSE 'Bank Transfr' END AS payment_s",
]


def exp_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense one-month daily history per user (over ``events``)."""
    return read_table(spark, sf_dir, "events").selectExpr(*EXP_DAILY_SELECT)


def exp_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long multi-year history (over ``orders``)."""
    return read_table(spark, sf_dir, "orders").selectExpr(*EXP_MONTHLY_SELECT)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").selectExpr(*USERS_SELECT)


def budgets_from(expenses: DataFrame) -> DataFrame:
    """One budget per (user, month, category) seen, plus an Overall row."""
    keys = expenses.select("user_id", month_key("date").alias("month"), "category").distinct()
    per_cat = keys.select(
        "user_id", "month", "category",
        (F.lit(500) + (F.col("user_id") % 5) * 100).cast("double").alias("budget_amount"))
    overall = (keys.select("user_id", "month").distinct()
               .select("user_id", "month", F.lit("Overall").alias("category"),
                       (F.lit(2500) + (F.col("user_id") % 5) * 500).cast("double")
                       .alias("budget_amount")))
    return per_cat.unionByName(overall)


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets_from(exp_daily(spark, sf_dir))


def budget_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming budget rows derived from the budgets: raise 'purchase'
    budgets, set Overall twice (the later ``seq`` wins) and open next month."""
    b = budgets(spark, sf_dir)
    cat = b.filter(F.col("category") == "purchase").select(
        "user_id", "month", "category", (F.col("budget_amount") + 50).alias("budget_amount"),
        F.lit(1).alias("seq"))
    ov = b.filter(F.col("category") == "Overall")
    ov1 = ov.select("user_id", "month", "category",
                    (F.col("budget_amount") + 100).alias("budget_amount"), F.lit(1).alias("seq"))
    ov2 = ov.select("user_id", "month", "category",
                    (F.col("budget_amount") + 200).alias("budget_amount"), F.lit(2).alias("seq"))
    nxt = ov.select("user_id", F.lit("2024-02").alias("month"), "category",
                    F.lit(3000.0).alias("budget_amount"), F.lit(1).alias("seq"))
    return cat.unionByName(ov1).unionByName(ov2).unionByName(nxt)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bills over ``orders``: a customer's orders of a year, billed on
    one day of the month, so that runs of months recur."""
    return read_table(spark, sf_dir, "orders").selectExpr(*SUBSCRIPTIONS_SELECT)


def purge_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts to delete: the customers of one market segment."""
    return users(spark, sf_dir).filter(F.col("segment") == "AUTOMOBILE").select(
        F.col("id").alias("user_id"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exp_daily(spark, sf_dir).selectExpr(*RAW_SELECT)


def raw_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First raw source: lower-case column names, all strings (even ids)."""
    return _raw(spark, sf_dir).filter(F.col("id") % 2 == 0).select(
        F.col("date_s").alias("date"), F.col("category_s").alias("category"),
        F.col("amount_s").alias("amount"), F.col("notes_s").alias("notes"),
        F.col("type_s").alias("transaction_type"), F.col("payment_s").alias("payment_mode"))


def raw_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second raw source: the other naming scheme (odd ids)."""
    return _second_names(_raw(spark, sf_dir).filter(F.col("id") % 2 == 1))


def raw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw rows under the second naming scheme."""
    return _second_names(_raw(spark, sf_dir))


def _second_names(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("date_s").alias("Date"), F.col("category_s").alias("Category"),
        F.col("amount_s").alias("Amount"), F.col("notes_s").alias("Note"),
        F.col("type_s").alias("Income/Expense"), F.col("payment_s").alias("Mode"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change set over exp_daily: updates (id%10=0; a second, later patch of
    another field for id%20=0), deletes (id%10=1), inserts (id%10=2 -> id+1,000,000)."""
    e = exp_daily(spark, sf_dir)
    null_s, null_d, null_x = (F.lit(None).cast(t) for t in ("string", "date", "double"))
    upd = e.filter(F.col("id") % 10 == 0).select(
        F.lit("update").alias("op"), "id", "user_id", null_d.alias("date"),
        null_s.alias("category"), (F.col("amount") + 1).alias("amount"),
        null_s.alias("payment_mode"), null_s.alias("notes"), F.lit(1).alias("seq"))
    upd2 = e.filter(F.col("id") % 20 == 0).select(
        F.lit("update").alias("op"), "id", "user_id", null_d.alias("date"),
        null_s.alias("category"), null_x.alias("amount"),
        F.lit("UPI").alias("payment_mode"), null_s.alias("notes"), F.lit(2).alias("seq"))
    dele = e.filter(F.col("id") % 10 == 1).select(
        F.lit("delete").alias("op"), "id", "user_id", null_d.alias("date"),
        null_s.alias("category"), null_x.alias("amount"), null_s.alias("payment_mode"),
        null_s.alias("notes"), F.lit(1).alias("seq"))
    ins = e.filter(F.col("id") % 10 == 2).select(
        F.lit("insert").alias("op"), (F.col("id") + 1000000).alias("id"), "user_id", "date",
        "category", "amount", null_s.alias("payment_mode"), null_s.alias("notes"),
        F.lit(1).alias("seq"))
    return upd.unionByName(upd2).unionByName(dele).unionByName(ins)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user CSV uploads (all strings, capitalised header) over the raw rows."""
    return _raw(spark, sf_dir).select(
        "user_id", F.col("date_s").alias("Date"), F.col("category_s").alias("Category"),
        F.col("amount_s").alias("Amount"), F.col("payment_s").alias("Payment_Mode"),
        F.col("notes_s").alias("Notes"))


def note_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled notes for the classifier: whole cleaned text -> language."""
    from ..functions import clean_text
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", clean_text("text").alias("clean_notes"),
                    F.col("lang").alias("category"))


# --- the same views as DuckDB SQL ------------------------------------------

def _sel(items):
    return ",\n  ".join(items)


VIEW_SQL = {
    "exp_daily": f"SELECT {_sel(EXP_DAILY_SELECT)} FROM events",
    "exp_monthly": f"SELECT {_sel(EXP_MONTHLY_SELECT)} FROM orders",
    "subscriptions": f"SELECT {_sel(SUBSCRIPTIONS_SELECT)} FROM orders",
    "users": f"SELECT {_sel(USERS_SELECT)} FROM customer",
    "budgets": (
        "SELECT user_id, month, category, CAST(500 + (user_id % 5) * 100 AS DOUBLE) AS budget_amount "
        "FROM (SELECT DISTINCT user_id, strftime(date, '%Y-%m') AS month, category FROM exp_daily) k "
        "UNION ALL "
        "SELECT user_id, month, 'Overall' AS category, CAST(2500 + (user_id % 5) * 500 AS DOUBLE) "
        "FROM (SELECT DISTINCT user_id, strftime(date, '%Y-%m') AS month FROM exp_daily) m"),
    "budget_changes": (
        "SELECT user_id, month, category, budget_amount + 50 AS budget_amount, 1 AS seq FROM budgets "
        "WHERE category = 'purchase' UNION ALL "
        "SELECT user_id, month, category, budget_amount + 100, 1 FROM budgets WHERE category = 'Overall' "
        "UNION ALL SELECT user_id, month, category, budget_amount + 200, 2 FROM budgets "
        "WHERE category = 'Overall' UNION ALL "
        "SELECT user_id, '2024-02', category, 3000.0, 1 FROM budgets WHERE category = 'Overall'"),
    "purge_users": "SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'AUTOMOBILE'",
    "raw": f"SELECT {_sel(RAW_SELECT)} FROM exp_daily",
    "raw_a": ("SELECT date_s AS date, category_s AS category, amount_s AS amount, notes_s AS notes, "
              "type_s AS transaction_type, payment_s AS payment_mode FROM raw WHERE id % 2 = 0"),
    "raw_b": ("SELECT date_s AS \"Date\", category_s AS \"Category\", amount_s AS \"Amount\", "
              "notes_s AS \"Note\", type_s AS \"Income/Expense\", payment_s AS \"Mode\" "
              "FROM raw WHERE id % 2 = 1"),
    "uploads": ("SELECT user_id, date_s AS \"Date\", category_s AS \"Category\", amount_s AS \"Amount\", "
                "payment_s AS \"Payment_Mode\", notes_s AS \"Notes\" FROM raw"),
    "changes": (
        "SELECT 'update' AS op, id, user_id, CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS category, "
        "amount + 1 AS amount, CAST(NULL AS VARCHAR) AS payment_mode, CAST(NULL AS VARCHAR) AS notes, 1 AS seq "
        "FROM exp_daily WHERE id % 10 = 0 UNION ALL "
        "SELECT 'update', id, user_id, NULL, NULL, NULL, 'UPI', NULL, 2 FROM exp_daily WHERE id % 20 = 0 "
        "UNION ALL SELECT 'delete', id, user_id, NULL, NULL, NULL, NULL, NULL, 1 FROM exp_daily WHERE id % 10 = 1 "
        "UNION ALL SELECT 'insert', id + 1000000, user_id, date, category, amount, NULL, NULL, 1 "
        "FROM exp_daily WHERE id % 10 = 2"),
    "note_labels": (
        "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9\\s]', '', 'g'), "
        "'\\s+', ' ', 'g')) AS clean_notes, lang AS category FROM documents"),
}

VIEW_DEPS = {
    "budgets": ["exp_daily"],
    "budget_changes": ["budgets"],
    "raw": ["exp_daily"],
    "raw_a": ["raw"],
    "uploads": ["raw"],
    "raw_b": ["raw"],
    "changes": ["exp_daily"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named views (and what they need)."""
    order: list[str] = []

    def visit(n):
        for d in VIEW_DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in order)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
