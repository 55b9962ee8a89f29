"""Model evaluation (M11, K5): metrics as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import half_even
from ..session import materialize


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       keys=()) -> DataFrame:
    """N, MAE, RMSE and R^2 (per key, or overall), in one pass: the
    squared deviation from the mean is ``var_pop * n``.  R^2 of a constant
    series is 1 if all predictions are right, else 0; of a single row NULL."""
    e = F.col(actual) - F.col(predicted)
    n, sq, dev = F.count(F.lit(1)), F.sum(e * e), F.var_pop(actual) * F.count(actual)
    r2 = (F.when(n < 2, F.lit(None).cast("double"))
          .when(F.min(actual) < F.max(actual), F.lit(1.0) - F.try_divide(sq, dev))
          .otherwise(F.when(sq == 0, 1.0).otherwise(0.0)))
    return df.groupBy(*keys).agg(
        n.alias("n"),
        half_even(F.avg(F.abs(e)), 4).alias("mae"),
        half_even(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        half_even(r2, 6).alias("r2"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          weight: str | None = None) -> DataFrame:
    """K5: per class precision / recall / F1 / support, plus accuracy,
    macro and weighted averages, from confusion counts (one group-by, written
    once when the frame is built: classes x classes rows).  ``weight`` names a
    count column when the rows are already counted."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    conf = materialize(df.groupBy(label, prediction).agg(n.alias("n")), "confusion")
    tp = conf.filter(F.col(label) == F.col(prediction)).select(
        F.col(label).alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col(label).alias("cls")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(F.col(prediction).alias("cls")).agg(F.sum("n").alias("predicted"))
    per = (sup.join(pred, "cls", "full_outer").join(tp, "cls", "left")
           .fillna(0, subset=["tp", "support", "predicted"]))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", p).withColumn("recall", r)
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    rows = per.select(
        F.col("cls").alias("row"), "precision", "recall", "f1", F.col("support").cast("long"))
    tot = per.agg(F.sum("support").alias("N"), F.sum("tp").alias("TP"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("row"), (F.col("TP") / F.col("N")).alias("precision"),
                     (F.col("TP") / F.col("N")).alias("recall"), (F.col("TP") / F.col("N")).alias("f1"),
                     F.col("N").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("N").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("row"), (F.col("wp") / F.col("N")).alias("precision"),
                          (F.col("wr") / F.col("N")).alias("recall"), (F.col("wf") / F.col("N")).alias("f1"),
                          F.col("N").cast("long").alias("support"))
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("row", *[half_even(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      "support")
