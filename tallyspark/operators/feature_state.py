"""Feature tables kept up to date from a small state.

Every lag and rolling window of the daily feature tables looks back 14 rows
at most, so a key's last 14 days are all that later rows need.  The state
holds them, one row for each key: ``(key..., tail array<struct<ds, y>>)`` in
date order.  ``advance`` reads the state and the new days only, whatever the
length of the history, and gives the features of the new days and the next
state.  Feeding a history in any number of batches gives the rows of the
batch tables.

State and new days meet in one join on the key; the windows over the opened
tails share its partitioning.  A key's rows there are its new days and 14 more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, StructType

from .series import DAILY_LAGS, calendar_features, calendar_gap_fill, lag_features, rolling_partial, rolling_strict

#: rows that a new day's windows reach back
REACH = 14
TAIL = "array<struct<ds:date,y:double>>"


class Step(NamedTuple):
    """``features``: rows of the new days; ``state``: to be stored for the
    next call; ``late``: days not after their key's last day, left out."""
    features: DataFrame
    state: DataFrame
    late: DataFrame


def empty_state(spark: SparkSession, days: DataFrame, keys=("user_id",)) -> DataFrame:
    """The state before any day, with the key types of ``days``."""
    schema = StructType([days.schema[k] for k in keys]).add(
        "tail", ArrayType(StructType().add("ds", DateType()).add("y", DoubleType())))
    return spark.createDataFrame([], schema)


def advance(state: DataFrame, days: DataFrame, keys=("user_id",), gap_fill: bool = False) -> Step:
    """Features of ``days`` (key..., ds, y: one row for each key and day, as
    ``daily_totals`` gives) after ``state``, and the next state.

    ``gap_fill=False`` gives the rows of ``feature_table_daily``,
    ``gap_fill=True`` those of ``feature_table_daily_gapfilled``; a state
    belongs to one of the two.  Days without a date or key are ignored.  A
    day on or before its key's last day can't be fed (rows after it are out
    already): it is returned in ``late``, for a ``rebuild`` of its key.  Keys
    without new days keep their tail; an empty table of days changes nothing.
    """
    keys = list(keys)
    usable = days.select(*keys, "ds", F.col("y").cast("double").alias("y")).dropna(subset=[*keys, "ds"])
    fed = usable.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("__new"))
    both = (state.select(*keys, "tail").join(fed, keys, "full")
            .withColumn("__last", F.element_at(F.col("tail"), -1)["ds"])
            .withColumn("__new", F.coalesce("__new", F.array().cast(TAIL)))
            .withColumn("tail", F.coalesce("tail", F.array().cast(TAIL))))
    timely = F.filter("__new", lambda d: F.col("__last").isNull() | (d["ds"] > F.col("__last")))
    late = (both.select(*keys, F.explode(F.filter("__new", lambda d: d["ds"] <= F.col("__last"))).alias("__d"))
            .select(*keys, "__d.ds", "__d.y"))
    opened = (both.select(*keys, "__last", F.explode(F.concat("tail", timely)).alias("__d"))
              .select(*keys, "__last", "__d.ds", "__d.y"))
    if gap_fill:
        last = both.select(*keys, "__last")
        opened = calendar_gap_fill(opened, keys).join(last, keys)
    rows = lag_features(calendar_features(opened), keys=keys)
    rows = rolling_strict(rows, keys=keys) if gap_fill else rolling_partial(rows, keys=keys)
    need = [f"lag_{k}" for k in DAILY_LAGS] + (["rolling_7", "rolling_14"] if gap_fill else [])
    features = (rows.filter(F.col("__last").isNull() | (F.col("ds") > F.col("__last")))
                .dropna(subset=need).drop("__last"))
    return Step(features, _tails(opened, keys), late)


def _tails(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("ds").desc())
    kept = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= REACH)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).cast(TAIL).alias("tail"))


def rebuild(state: DataFrame, history: DataFrame, late: DataFrame, keys=("user_id",),
            gap_fill: bool = False) -> Step:
    """The whole feature rows of the keys that have ``late`` days, from their
    ``history`` (late days included), and the state with their new tails."""
    keys = list(keys)
    who = late.select(*keys).distinct()
    mine = history.join(who, keys, "semi")
    fresh = advance(state.limit(0), mine, keys, gap_fill)
    kept = state.join(who, keys, "anti").unionByName(fresh.state)
    return Step(fresh.features, kept, fresh.late)


def open_state(state: DataFrame, keys=("user_id",)) -> DataFrame:
    """(key..., ds, y): the state's tails as rows."""
    return state.select(*keys, F.inline("tail"))
