"""The daily horizon of a fitted tree ensemble for batches of users (M3).

The same days as ``models.daily_recursion`` with the ensemble in column form,
to the last bit: features, trees and sums are taken in that order.  A batch
holds one short row for each user; numpy goes through all trees at once where
the column form evaluates one split of one user after another.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .series import calendar_columns
from .tree_columns import TreeColumns

#: users whose horizon is computed at once
CHUNK = 512
# workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _values(trees: tuple, x: np.ndarray) -> np.ndarray:
    """``TreeColumns.predict`` for the rows of ``x`` (a missing feature is NaN)."""
    count, depth, feature, threshold, leaf = trees
    inner, outer = (1 << depth) - 1, 1 << depth
    tree, flat = np.arange(count), x.ravel()
    row = np.arange(len(x))[:, None] * x.shape[1]
    node = np.zeros((len(x), count), dtype=np.int64)
    for _ in range(depth):
        at = tree * inner + node
        node = node * 2 + np.where(flat[row + feature[at]] <= threshold[at], 1, 2)
    return np.cumsum(leaf[tree * outer + node - inner], axis=1)[:, -1]  # one tree after another


def _sum_left(columns: np.ndarray) -> np.ndarray:
    """Sums in the order of ``aggregate``."""
    total = np.zeros(columns.shape[1])
    for c in columns:
        total += c
    return total


def _days(trees: tuple, lags: list[int], calendar: np.ndarray, vals: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The days after each user's last one.

    ``calendar``: (users, days, calendar features); ``vals``: the last values,
    at the right, zeros before the first of a user's ``n``.  A missing value
    is NaN.  The features are those of ``models.daily_features``."""
    depth, periods = vals.shape[1], calendar.shape[1]
    v = np.concatenate([vals, np.zeros((len(vals), periods))], axis=1).T.copy()
    for at in range(depth, depth + periods):
        have = n + at - depth
        mean = _sum_left(v[at - 7:at]) / np.minimum(have, 7)
        mean_6 = _sum_left(v[at - 6:at]) / 6
        std = np.sqrt(_sum_left((v[at - 6:at] - mean_6) * (v[at - 6:at] - mean_6)) / 5)
        x = np.column_stack([calendar[:, at - depth], *[v[at - k] for k in lags], mean_6, _sum_left(v[at - 13:at]) / 13, std])
        v[at] = np.where(have < depth, mean, np.maximum(_values(trees, x), 0.0))
    return v[depth:].T


def tree_horizon(state: DataFrame, key: str, trees: TreeColumns, features: list[str], lags: list[int],
                 periods: int) -> DataFrame:
    """(key, last_ds, days: the ``periods`` predictions) for rows of (key,
    last_ds, vals).  ``features``: those of the calendar, the lags, the means
    of 7 and 14 days, the deviation of 7."""
    names, depth = features[:-len(lags) - 3], max(lags)

    def calendar(k: Column) -> Column:
        f = calendar_columns(F.date_add(F.col("last_ds"), k))
        return F.array(*[f[x].cast("int") for x in names])

    days = F.transform(F.sequence(F.lit(1), F.lit(periods)), calendar)
    rows = state.select(key, "last_ds", "vals", F.flatten(days).alias("calendar"))
    shared = state.sparkSession.sparkContext.broadcast(
        (trees.trees, trees.depth, np.array(trees.features, dtype=np.int64), np.array(trees.thresholds), np.array(trees.leaves)))
    schema = StructType([state.schema[key], state.schema["last_ds"], StructField("days", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                b = whole.slice(start, CHUNK)
                n = b.column("vals").value_lengths().to_numpy()
                vals = np.zeros((b.num_rows, depth))
                vals[np.arange(depth) >= depth - n[:, None]] = b.column("vals").flatten().to_numpy(zero_copy_only=False)
                ahead = b.column("calendar").flatten().to_numpy().reshape(b.num_rows, periods, len(names))
                got = pa.array(_days(shared.value, lags, ahead, vals, n).ravel(), from_pandas=True)
                at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * periods)
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("last_ds"), pa.ListArray.from_arrays(at, got)],
                                                 names=[key, "last_ds", "days"])

    return rows.mapInArrow(run, schema)
