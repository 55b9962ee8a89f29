"""CSV / Parquet sources and sinks.

Paths may be local folders in tests and shared storage (HDFS, object
stores) on a cluster; nothing here touches a machine-local folder of its
own: scratch output goes under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.date_text import parse_date
from ..operators.clean import parse_number
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sinks/{name}-{uuid.uuid4().hex}"


def read_transactions_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A raw transaction CSV with a header, every column read as text
    (parsing is explicit and never raises later: ``try_cast``)."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return csv_reader(spark).option("enforceSchema", False).schema(schema).csv(path)


def csv_reader(spark: SparkSession):
    """Reader of CSV as pandas writes it: quotes doubled, line breaks inside
    quoted fields (such files are read whole, so keep them of task size)."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True))


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
              mode: str = "overwrite") -> str:
    w = (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def export_expenses_csv(df: DataFrame, path: str, buckets: int = 64) -> str:
    """Every user's expenses as CSV, in a fixed number of folders by a
    hash of the user (a user's rows lie in one folder).  The rebalance gathers
    a bucket's rows in few files and lets AQE split a very active user's."""
    placed = df.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    return write_csv(placed.hint("rebalance", "bucket"), path, ["bucket"])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """Persist a frame as Parquet (columnar, exact round trip)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_budgets(budgets: DataFrame, path: str, mode: str = "overwrite") -> str:
    """S8 layout: budgets partitioned by ``month`` so that a month predicate
    (``scan_budgets``) reads only that month's folder."""
    return write_table(budgets, path, ["month"], mode)


def append_forecast_history(totals: DataFrame, path: str, forecast_date: str, model: str,
                            periods: int) -> str:
    """Append one history row per user: (user, date, model, periods, total)."""
    rows = totals.select("user_id", F.lit(forecast_date).cast("date").alias("forecast_date"),
                         F.lit(model).alias("model_used"),
                         F.lit(periods).cast("int").alias("forecast_period"),
                         F.col("total_predicted").cast("double"))
    rows.write.mode("append").parquet(path)
    return path


# --- upload import (S3, S4) --------------------------------------------------

def _pick(df: DataFrame, names: list[str]):
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return None


def import_expenses(df: DataFrame, as_of: str, user_col: str = "user_id",
                    observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Map an uploaded table onto expenses.

    Columns are found under either spelling (``Date``/``date`` ...).  An
    absent column takes its default (as_of / 'Other' / 0 / 'Cash' / '');
    a present but empty text becomes 'nan' (what ``str()`` of a missing
    value gives).  Rows whose date or amount does not parse are returned
    in the second frame with a reason instead of being dropped silently.
    With an ``Observation`` the imported / rejected counts are collected
    by the action that consumes the rows (no extra count job)."""
    date_s = _pick(df, ["Date", "date"])
    amount_s = _pick(df, ["Amount", "amount"])

    def text(names, default):
        c = _pick(df, names)
        return F.lit(default) if c is None else F.coalesce(c, F.lit("nan"))

    if date_s is None:
        date = F.lit(as_of).cast("date")
    else:
        date = parse_date(date_s, int(as_of[:4]))
    amount = F.lit(0.0) if amount_s is None else parse_number(amount_s)
    parsed = df.select(
        F.col(user_col).alias("user_id"), date.alias("date"),
        text(["Category", "category"], "Other").alias("category"), amount.alias("amount"),
        text(["Payment_Mode", "payment_mode"], "Cash").alias("payment_mode"),
        text(["Notes", "notes"], "").alias("notes"))
    reason = (F.when(F.col("date").isNull(), F.lit("bad_date"))
              .when(F.col("amount").isNull(), F.lit("bad_amount")))
    tagged = parsed.withColumn("reason", reason)
    if observation is not None:
        # imported / rejected counts come out of the same action that writes
        tagged = tagged.observe(observation,
                                F.count_if(F.col("reason").isNull()).alias("imported"),
                                F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    good = tagged.filter(F.col("reason").isNull()).drop("reason")
    bad = tagged.filter(F.col("reason").isNotNull())
    return good, bad


def reject_report(rejected: DataFrame) -> DataFrame:
    """Rejected rows per user and reason."""
    return rejected.groupBy("user_id", "reason").agg(F.count(F.lit(1)).alias("n"))
