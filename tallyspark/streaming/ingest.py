"""Streaming upload import and running month spend.

``stream_import`` applies the batch import rules (S3/S4) to CSV uploads
arriving in a folder: good rows append to the expense table, rejected rows
to a reject table; a checkpoint folder makes the sink exactly-once and lets
a restarted query continue where it stopped.

``stream_month_spend`` keeps spend per (user, category, month) up to date
as expenses arrive.  The month start is the event-time key with a
watermark, so state for months that can no longer change is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import money_sum
from ..sources.files import import_expenses

UPLOAD_COLUMNS = ["user_id", "Date", "Category", "Amount", "Payment_Mode", "Notes"]


def stream_import(spark: SparkSession, src: str, out: str, checkpoint: str, as_of: str,
                  columns: list[str] = UPLOAD_COLUMNS, available_now: bool = True
                  ) -> list[StreamingQuery]:
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    raw = (spark.readStream.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", True).csv(src))
    raw = raw.withColumn("user_id", F.col("user_id").try_cast("long"))
    good, bad = import_expenses(raw, as_of)
    queries = []
    for name, df in (("expenses", good), ("rejected", bad)):
        w = (df.writeStream.format("parquet").outputMode("append")
             .option("path", f"{out.rstrip('/')}/{name}")
             .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}"))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        queries.append(w.start())
    return queries


def month_spend_stream(expenses: DataFrame, lateness: str = "40 days") -> DataFrame:
    """Running spend per (user, category, month start) with a watermark."""
    e = expenses.withColumn("month_start", F.trunc("date", "month").cast("timestamp"))
    return (e.withWatermark("month_start", lateness)
            .groupBy("user_id", "category", "month_start")
            .agg(money_sum("amount").alias("spent"),
                 F.count(F.lit(1)).alias("n")))


def stream_month_spend(spark: SparkSession, src: str, schema: T.StructType, out: str,
                       checkpoint: str, lateness: str = "40 days") -> StreamingQuery:
    """Parquet expense files -> the changed rows of each batch under ``out``
    (a batch that runs again replaces its own folder)."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")

    stream = spark.readStream.schema(schema).parquet(src)
    return (month_spend_stream(stream, lateness).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_month_spend(spark: SparkSession, out: str) -> DataFrame:
    """The latest spend of every (user, category, month start)."""
    return (spark.read.parquet(out).groupBy("user_id", "category", "month_start")
            .agg(F.max_by(F.struct("spent", "n"), "batch").alias("v"))
            .select("user_id", "category", "month_start", "v.spent", "v.n"))
