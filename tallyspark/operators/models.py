"""Boosted-tree forecasts with MLlib.

One model is fitted on the pooled feature rows of all users (the feature
table is an ordinary distributed DataFrame).  Multi-step prediction is
sequential in time but parallel over users: the state is one row per user
with an array of its last values.  The whole horizon is one stage, no job or
checkpoint for a step, and a lost executor's users are recomputed from their
series: fitted daily trees go over a batch of users at once in numpy, other
predictors and the monthly trees are column expressions (``tree_columns``) in
one ``aggregate`` over that array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BAND, MIN_HISTORY
from ..session import cut_lineage, discard, materialize
from .forecast import eligible
from .reports import daily_totals
from .series import (DAILY_LAGS, calendar_columns, calendar_gap_fill, feature_table_daily,
                     feature_table_monthly)
from .sharded import ShardedModel, load_sharded, save_sharded
from .tree_columns import TreeColumns, tree_columns
from .tree_horizon import tree_horizon

#: a prediction column from named feature columns
Predictor = Callable[[dict[str, Column]], Column]

USER = "user_id"
DAILY_FEATURES = ["month", "day", "dayofweek", "quarter", "dayofyear", "weekofyear", "is_weekend",
                  "lag_1", "lag_2", "lag_3", "lag_7", "lag_14",
                  "rolling_mean_7", "rolling_mean_14", "rolling_std_7"]
MONTHLY_FEATURES = ["month_num", "year_num", "quarter", "lag_1", "lag_2", "lag_3",
                    "rolling_3", "rolling_6"]
# reference hyper-parameters: daily service model and notebook monthly model
DAILY_GBT = dict(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.8,
                 featureSubsetStrategy="0.8", seed=42)
MONTHLY_GBT = dict(maxIter=100, maxDepth=3, stepSize=0.1, seed=42)
#: rows that a task of the fit has at least
TASK_ROWS = 1 << 15


def fit_trees(train: DataFrame, features: list[str], label: str = "y", **params):
    """The fitted pipeline; rows with a missing feature or label are left out
    of the fit but kept when it predicts (the caller replaces those)."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(labelCol=label, featuresCol="features", **params)
    return Pipeline(stages=[asm, gbt]).fit(train.dropna(subset=[*features, label]))


def save_model(model: PipelineModel | ShardedModel, path: str) -> str:
    """Write a fitted pipeline or table model (shared storage on a cluster)."""
    if isinstance(model, ShardedModel):
        save_sharded(model, path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | ShardedModel:
    spark = SparkSession.getActiveSession()
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/coefficients")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return load_sharded(spark, path)
    return PipelineModel.load(path)


def tree_predictor(model, features: list[str]) -> Predictor:
    """A fitted ensemble in column form, over features by name."""
    trees = tree_columns(model)
    return lambda f: trees.predict(F.array(*[f[x].cast("double") for x in features]))


def _arr_mean(arr):
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr))


def _last(arr, n: int):
    """The last ``n`` values, or all of a shorter array (``slice`` from the
    end would give none)."""
    return F.slice(arr, F.greatest(F.size(arr) - n, F.lit(0)) + 1, n)


def _arr_std(arr):
    m = _arr_mean(arr)
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(arr) > 1, F.sqrt(F.try_divide(ss, F.size(arr) - 1))).otherwise(F.lit(0.0))


def series_state(series: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """One row per key: last ds and its last ``depth`` values (bounded)."""
    w = Window.partitionBy(*keys).orderBy(F.col("ds").desc())
    last = series.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= depth)
    return last.groupBy(*keys).agg(
        F.max("ds").alias("last_ds"),
        F.transform(F.sort_array(F.collect_list(F.struct("ds", "y"))), lambda r: r["y"]).alias("vals"),
    )


def daily_features(vals: Column, ds: Column) -> dict[str, Column]:
    """Features of the day ``ds`` from the values before it, as the reference
    builds them at prediction time: the day's own value is unknown, so the
    7/14-row windows hold the previous 6/13 values."""
    f = calendar_columns(ds)
    for k in DAILY_LAGS:
        f[f"lag_{k}"] = F.when(F.size(vals) >= k, F.element_at(vals, -k))
    f["rolling_mean_7"] = _arr_mean(F.slice(vals, -6, 6))
    f["rolling_mean_14"] = _arr_mean(F.slice(vals, -13, 13))
    f["rolling_std_7"] = _arr_std(F.slice(vals, -6, 6))
    return f


def _horizon(start: Column, periods: int, step: Callable[[Column, Column], Column]) -> Column:
    """``start`` with ``periods`` values appended, each from the array so far
    and its number (from 1): the whole horizon in one expression."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(periods)), start,
                       lambda vals, k: F.concat(vals, F.array(step(vals, k))))


def daily_recursion(daily: DataFrame, predict: Predictor | TreeColumns | None, periods: int = 30) -> DataFrame:
    """(user_id, ds, yhat, yhat_lower, yhat_upper): ``periods`` days after each
    user's last one, each predicted from the days before it, clipped at 0,
    with a +-20 % band.

    ``predict`` maps named feature columns to a prediction column, or is a
    fitted ensemble over ``DAILY_FEATURES``.  Without one, without its value,
    or while a user's lags are incomplete, the mean of the last 7 values
    stands in.  The horizon is one stage over the users' last values: no job,
    checkpoint or shuffle for a day."""
    depth = max(DAILY_LAGS)
    state = series_state(daily, [USER], depth)

    def step(vals: Column, k: Column) -> Column:
        mean = _arr_mean(_last(vals, 7))
        if predict is None:
            return mean
        p = predict(daily_features(vals, F.date_add(F.col("last_ds"), k)))
        return F.when(F.size(vals) < depth, mean).otherwise(F.coalesce(F.greatest(p, F.lit(0.0)), mean))

    if isinstance(predict, TreeColumns):
        days = tree_horizon(state, USER, predict, DAILY_FEATURES, DAILY_LAGS, periods)
    else:
        days = (state.withColumn("all", _horizon(F.col("vals"), periods, step))
                .select(USER, "last_ds", F.slice("all", F.size("vals") + 1, periods).alias("days")))
    out = days.select(USER, "last_ds", F.posexplode("days").alias("pos", "yhat"))
    return out.select(USER, F.date_add("last_ds", F.col("pos") + 1).alias("ds"), "yhat",
                      (F.col("yhat") * (1 - BAND)).alias("yhat_lower"),
                      (F.col("yhat") * (1 + BAND)).alias("yhat_upper"))


def boosted_tree_forecast(expenses: DataFrame, periods: int = 30, params: dict | None = None,
                          min_history: int = MIN_HISTORY["trees"], gap_fill: bool = False,
                          predict: Predictor | None = None) -> DataFrame:
    """M3: pooled GBT on observed-day features, iterated day by day,
    clipped at 0, +-20 % band.  Users with fewer than ``min_history`` days
    are left out (``forecast_dispatch`` reports them); while a user's lags
    are incomplete, the mean of the last 7 values stands in.  The model is
    fitted when the frame is built, unless ``predict`` is given; the steps
    are one lazy expression.  The service path uses observed days only;
    ``gap_fill`` fills missing days with 0 first (the UI path, Q4)."""
    daily = daily_totals(expenses)
    if gap_fill:
        daily = calendar_gap_fill(daily)
    series, (daily, _) = daily, eligible(daily, min_history)
    if predict is None:
        train = feature_table_daily(daily.select(USER, F.col("ds").alias("date"), F.col("y").alias("amount")))
        train = train.dropna(subset=[*DAILY_FEATURES, "y"]).select(USER, "ds", *DAILY_FEATURES, "y")
        kept = materialize(train, "tree-rows")
        if rows := kept.count():  # else nothing to learn from: trailing means
            parts = min(train.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS)
            if parts > 1:  # fewer rows are fitted in the partitions they come in
                train = _evenly(kept, parts)
            predict = tree_columns(fit_trees(train, DAILY_FEATURES, **(params or DAILY_GBT)))
        discard(kept)
    # a number of its own: sized by bytes, the few small rows of all users would share a task
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return daily_recursion(eligible(series.repartition(parts, USER), min_history)[0], predict, periods)


def _evenly(rows: DataFrame, parts: int) -> DataFrame:
    """Training rows in partitions of about the same size, in a fixed order.
    A tree takes a stage for each of its levels: with a task for each core,
    not one or two more, every stage is a single wave."""
    return rows.repartition(parts, USER, "ds").sortWithinPartitions(USER, "ds")


# --- monthly (M4, M5, M12) --------------------------------------------------

def monthly_split(series: DataFrame, test_rows: int = 6) -> tuple[DataFrame, DataFrame]:
    """Monthly feature rows: (all but the last ``test_rows``, the last ones)."""
    feats = feature_table_monthly(series)
    w = Window.orderBy(F.col("ds").desc())  # monthly rows: one per calendar month
    feats = feats.withColumn("_r", F.row_number().over(w))
    return feats.filter(F.col("_r") > test_rows), feats.filter(F.col("_r") <= test_rows)


def fit_monthly(train: DataFrame, params: dict | None = None) -> PipelineModel:
    """M4: the monthly trees."""
    return fit_trees(train, MONTHLY_FEATURES, **(params or MONTHLY_GBT))


def predict_monthly(model: PipelineModel, test: DataFrame) -> DataFrame:
    """M4: (ds, actual, predicted) on the held-out months."""
    return model.transform(test).select("ds", F.col("y").alias("actual"), F.col("prediction").alias("predicted"))


def feature_importance(model, features: list[str] = MONTHLY_FEATURES) -> DataFrame:
    """Importances of the fitted trees (one small row per feature)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])),
                                 "feature string, importance double")


def monthly_features(vals: Column, ds: Column) -> dict[str, Column]:
    """Features of the month ``ds`` from the values before it (actuals, then
    predictions); rolling means cover the 3 / 6 preceding values."""
    f = {"month_num": F.month(ds), "year_num": F.year(ds), "quarter": F.quarter(ds)}
    for k in (1, 2, 3):
        f[f"lag_{k}"] = F.element_at(vals, -k)
    f["rolling_3"] = _arr_mean(F.slice(vals, -3, 3))
    f["rolling_6"] = _arr_mean(F.slice(vals, -6, 6))
    return f


def monthly_step_features(state: DataFrame) -> DataFrame:
    """The next month's features from a state row."""
    f = state.withColumn("ds", F.add_months("last_ds", 1))
    return f.withColumns(monthly_features(F.col("vals"), F.col("ds")))


def monthly_recursion(series: DataFrame, predict: Predictor, months: int = 6) -> DataFrame:
    """M5: (ds, features..., predicted) for ``months`` future months, each
    step's lags and rolling means from the preceding values including earlier
    predictions, in one expression over the last six values."""
    state = series_state(series.withColumn("_g", F.lit(0)), ["_g"], 6)

    def month(k: Column) -> Column:
        return F.add_months(F.col("last_ds"), k.cast("int"))

    grown = state.withColumn("all", _horizon(F.col("vals"), months, lambda vals, k: predict(monthly_features(vals, month(k)))))
    rows = grown.select("last_ds", "all", F.size("vals").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(months))).alias("k"))
    before = F.slice("all", F.lit(1), F.col("n") + F.col("k") - 1)
    rows = rows.select("k", "all", "n", before.alias("vals"), month(F.col("k")).alias("ds"))
    return rows.withColumns(monthly_features(F.col("vals"), F.col("ds"))).select(
        "ds", *MONTHLY_FEATURES, F.element_at("all", F.col("n") + F.col("k")).alias("predicted"))


def monthly_recursive_forecast(series: DataFrame, predict, months: int = 6) -> DataFrame:
    """M5 with a predictor that only maps a feature frame to the same frame
    plus ``prediction`` (``monthly_recursion`` takes one in column form): a
    job and a checkpoint for each month."""
    s = series.withColumn("_g", F.lit(0))
    state = series_state(s, ["_g"], 6)
    rows = None
    for _ in range(months):
        feats = monthly_step_features(state)
        pred = predict(feats)
        step = pred.select("ds", *MONTHLY_FEATURES, F.col("prediction").alias("predicted"))
        rows = step if rows is None else rows.unionByName(step)
        state = cut_lineage(pred.select(
            "_g", F.col("ds").alias("last_ds"),
            F.slice(F.concat("vals", F.array(F.col("prediction"))), -6, 6).alias("vals")))
        rows = cut_lineage(rows)
    return rows
