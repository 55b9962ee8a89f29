"""Quartiles of every key against NumPy, with a key that holds a third of all rows."""

import random

import numpy as np
import pytest

from tallyspark.operators.quantiles import histogram_by_key, quantiles_by_key
from tallyspark.operators.reports import describe_by_key


@pytest.mark.parametrize("partitions", [1, 16])
def test_equals_numpy(spark, partitions):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 40}", i % 2, None if i % 29 == 0 else float("nan") if i % 31 == 0 else rng.choice([rng.uniform(-9, 9), 1.0]))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, part int, v double")  # a column named as an inner one
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r.k, r.part): list(r)[2:] for r in quantiles_by_key(df, ["k", "part"], "v", probs, partitions=partitions).collect()}
    values = {}
    for k, p, v in rows:
        if v is not None and v == v:
            values.setdefault((k, p), []).append(v)
    assert set(got) == set(values)
    for key, v in values.items():
        assert got[key] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12, abs=1e-12), key


def test_hot_key_lies_in_many_parts(spark):
    """No task orders more than a range of the hot key's values."""
    df = spark.range(20000).selectExpr("IF(id % 3 = 0, 0, id % 7) AS k", "CAST(hash(id) AS DOUBLE) AS v")
    sizes = {(r.k[0], r.part): r["count"] for r in histogram_by_key(df, ["k"], "v", 16).groupBy("k", "part").count().collect()}
    assert len([1 for k, _ in sizes if k == 0]) >= 5 and max(sizes.values()) < 3000


def test_empty_and_lone_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, amount double")
    rows = describe_by_key(df, ["k"]).collect()
    assert [tuple(r) for r in rows] == [("b", 1, 2.0, None, 2.0, 2.0, 2.0, 2.0, 2.0)]
    assert describe_by_key(df.limit(0), ["k"]).count() == 0
