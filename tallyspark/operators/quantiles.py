"""Exact quantiles without gathering a column into one task.

1. ``hist``: (value, count) — a partial-aggregated group-by, so a value that
   holds a third of all rows is still one row.  It is the only pass over the
   input, written once when the frame is built.
2. Approximate split points over the distinct values (a bounded sketch) cut
   them into ``buckets`` ranges, found by binary search; per-range counts (at
   most ``buckets`` rows) give each range's first rank and the total.
3. Only the ranges holding a wanted rank are ordered, each in its own window
   partition, to read the value at that rank.
Interpolation is NumPy's linear rule (pandas ``describe``/``quantile``).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _lerp(lo: float, hi: float, frac: float) -> float:
    """NumPy's two-sided linear interpolation."""
    return hi - (hi - lo) * (1.0 - frac) if frac >= 0.5 else lo + (hi - lo) * frac


def exact_quantiles(df: DataFrame, col: str, probs: list[float], names: list[str] | None = None,
                    buckets: int = 256) -> DataFrame:
    """One row with a column for each of ``probs``; NULLs for no values."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    hist = materialize(x.groupBy("x").agg(F.count(F.lit(1)).alias("c")), "values")
    # split points over the *distinct* values balance the ranges by what the
    # later ordering has to sort
    cuts = [i / buckets for i in range(1, buckets)]
    found = hist.agg(F.percentile_approx("x", cuts, 10 * buckets).alias("s")).first()["s"] or []
    splits = [-math.inf, *sorted(set(found) - {math.inf, -math.inf}), math.inf]
    placed = Bucketizer(splits=splits, inputCol="x", outputCol="b", handleInvalid="keep").transform(hist)
    counts = sorted((int(r["b"]), r["n"]) for r in placed.groupBy("b").agg(F.sum("c").alias("n")).collect())
    start, total = {}, 0
    for b, n in counts:  # at most ``buckets`` of them
        start[b], total = total, total + n
    spark = df.sparkSession
    schema = ", ".join(f"{n} double" for n in names)
    if not total:
        return spark.createDataFrame([[None] * len(names)], schema)
    wanted = sorted({f(p * (total - 1)) for p in probs for f in (math.floor, math.ceil)})
    held = {b for b, n in counts if any(start[b] <= r < start[b] + n for r in wanted)}
    first = F.element_at(F.create_map(*[F.lit(float(v)) if k % 2 == 0 else F.lit(v) for b in sorted(held)
                                        for k, v in enumerate((b, start[b]))]), F.col("b"))
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranks = F.array(*[F.lit(r) for r in wanted])
    at = (placed.filter(F.col("b").isin([float(b) for b in held])).withColumn("end", first + upto)
          .withColumn("r", F.explode(F.filter(ranks, lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("c")))))
          .select("r", "x").collect())
    value = {r["r"]: r["x"] for r in at}
    row = [_lerp(value[math.floor(p * (total - 1))], value[math.ceil(p * (total - 1))],
                 p * (total - 1) - math.floor(p * (total - 1))) for p in probs]
    return spark.createDataFrame([row], schema)


def histogram_by_key(df: DataFrame, keys: list[str], col: str, partitions: int) -> DataFrame:
    """(k, x, c, part): the count of every value of every key, in parts of
    about equal size along (key, value); written once."""
    x = F.col(col).cast("double")
    hist = (df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(F.struct(*keys).alias("k"), x.alias("x"))
            .agg(F.count(F.lit(1)).alias("c")))
    return materialize(hist.repartitionByRange(partitions, "k", "x").withColumn("part", F.spark_partition_id()), "values-by-key")


def quantiles_by_key(df: DataFrame, keys: list[str], col: str, probs: list[float],
                     names: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(keys..., a column for each of ``probs``): exact quantiles of every
    key's values, NumPy's linear rule.  Null and NaN values don't count, keys
    without any value are left out, a null key is a key.

    Values are reduced to (key, value, count), range-sorted by key and value
    and written once, so a key with very many values lies in many parts.  The
    parts' counts say which part of a key holds a wanted rank; only those are
    ordered, each on its own."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    hist = histogram_by_key(df, keys, col, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of_key = Window.partitionBy("k")
    before = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (hist.groupBy("k", "part").agg(F.sum("c").alias("n"))
             .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(of_key)))
    places = [F.lit(p) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(v).cast("long") for v in places for f in (F.floor, F.ceil)]))
    inside = F.filter(ranks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    wanted = parts.select("k", "part", "start", "total", inside.alias("ranks")).filter(F.size("ranks") > 0)
    upto = F.sum("c").over(Window.partitionBy("k", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    at = (hist.join(wanted, ["k", "part"]).withColumn("end", F.col("start") + upto)
          .select("k", "total", "x", F.explode(F.filter("ranks", lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("c")))).alias("r")))
    sums = []
    for i, v in enumerate(places):
        sums += [F.max(F.when(F.col("r") == f(v).cast("long"), F.col("x"))).alias(f"{side}{i}") for side, f in (("lo", F.floor), ("hi", F.ceil))]
    got = at.groupBy("k", "total").agg(*sums)

    def lerp(i: int, v):
        lo, hi, frac = F.col(f"lo{i}"), F.col(f"hi{i}"), v - F.floor(v)
        return F.when(frac >= 0.5, hi - (hi - lo) * (1.0 - frac)).otherwise(lo + (hi - lo) * frac)

    return got.select(*[F.col("k")[k].alias(k) for k in keys], *[lerp(i, v).alias(name) for i, (v, name) in enumerate(zip(places, names))])
