"""The recorded monthly forecast artifact: rows 2-6 follow from the
previous rows' predictions (lags) and the preceding values (rolling means)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.models import monthly_recursive_forecast

# recorded rows: month, lag_1, lag_2, lag_3, rolling_3, rolling_6, prediction (fixed values)
RECORDED = [
    ("2025-01-01", 1018688.0, 628371.0, 636971.0, 761343.3333333334, 753558.3333333334, 819112.94),
    ("2025-02-01", 819112.9375, 1018688.0, 628371.0, 822057.3125, 789572.0, 646175.6),
    ("2025-03-01", 646175.625, 819112.9375, 1018688.0, 827992.1875, 771875.2604166666, 852915.375),
    ("2025-04-01", 852915.375, 646175.625, 819112.9375, 772734.6875, 767038.9895833334, 799234.875),
    ("2025-05-01", 799234.875, 852915.375, 646175.625, 766108.6875, 794082.96875, 607061.625),
    ("2025-06-01", 607061.625, 799234.875, 852915.375, 753070.6875, 790531.40625, 834895.4375),
]


def test_state_update_reproduces_artifact(spark):
    # the six last actual months: the first three follow from rolling_6 of rows 1-3
    x3 = 771875.2604166666 * 6 - (636971 + 628371 + 1018688 + 819112.9375 + 646175.625)
    x2 = 789572.0 * 6 - (636971 + 628371 + 1018688 + 819112.9375) - x3
    x1 = 753558.3333333334 * 6 - (636971 + 628371 + 1018688) - x2 - x3
    hist = [x1, x2, x3, 636971.0, 628371.0, 1018688.0]
    months = [dt.date(2024, m, 1) for m in range(7, 13)]
    series = spark.createDataFrame(list(zip(months, hist)), "ds date, y double")
    preds = {dt.date.fromisoformat(r[0]): r[6] for r in RECORDED}
    lookup = spark.createDataFrame(list(preds.items()), "ds date, prediction double")

    def predict(feats):
        return feats.join(F.broadcast(lookup), "ds")

    got = {r.ds: r for r in monthly_recursive_forecast(series, predict, 6).collect()}
    for m, l1, l2, l3, r3, r6, _ in RECORDED:
        row = got[dt.date.fromisoformat(m)]
        assert row.lag_1 == pytest.approx(l1, abs=0.1)
        assert row.lag_2 == pytest.approx(l2, abs=0.1)
        assert row.lag_3 == pytest.approx(l3, abs=0.1)
        assert row.rolling_3 == pytest.approx(r3, abs=0.1)
        assert row.rolling_6 == pytest.approx(r6, abs=0.1)
