"""Embedding near-duplicates by collision-counting projections.

Equal vectors are joined first; the rest works on one representative for
each.  Unit vectors are projected on fixed random directions.  Two vectors at
the cosine limit are at most ``width`` apart on a direction with a known
probability, so a pair is verified only if enough directions collide; the
number is calibrated to the wanted recall.  The first two directions cut each
label into cells of that width, and only neighbouring cells meet, in blocks
of bounded size.  In a block pair the third direction is sorted and each
query's window on it gives the first pairs; the other directions count on,
dropping pairs that can't reach the count.  Cosines are in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import Scratch
from .graph import components
from .simhash import _forest

COSINE, DIRECTIONS, SPREAD, RECALL, BLOCK = 0.98, 20, 4.5, 0.9999, 512


def directions(dim: int, n: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, n))


def calibrate(cosine: float, n: int, spread: float, recall: float) -> tuple[float, int]:
    """(width, needed collisions): a pair at the limit collides on all of the
    first three directions and on enough of all ``n`` with ``recall``."""
    width = spread * math.sqrt(max(2 - 2 * cosine, 1e-12))
    hit = math.erf(spread / math.sqrt(2))
    need, reached = n, hit ** n
    while reached < recall and need > 3:
        need -= 1
        k = n - need  # misses, all outside the first three
        reached += math.comb(n - 3, k) * hit ** need * (1 - hit) ** k
    return width, need


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def _cells(width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vector").to_pylist()
            dims = np.array([len(v) for v in vec], dtype=np.int64)
            cells = np.zeros((len(vec), 2), dtype=np.int32)
            packed = [np.array(v, dtype="<f8") for v in vec]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = unit(np.stack([packed[i] for i in at])) @ directions(int(d))[:, :2]
                cells[at] = np.floor(p / width)
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(dims.astype(np.int32)), pa.array(cells[:, 0]), pa.array(cells[:, 1]),
                 b.column("rep"), b.column("n"), pa.array([x.tobytes() for x in packed], pa.binary())],
                names=["label", "dim", "c1", "c2", "rep", "n", "vec"])
    return run


def _windows(a: np.ndarray, b: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with b[j] in the window centred on a[i]."""
    order = np.argsort(b, kind="stable")
    lo = np.searchsorted(b[order], a - width, side="left")
    n = np.searchsorted(b[order], a + width, side="right") - lo
    ends = np.cumsum(n)
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) + np.repeat(lo - (ends - n), n)]


def near_pairs(x: np.ndarray, y: np.ndarray, same: bool, cosine: float, width: float, need: int):
    """Index pairs of unit vectors that reach the count and the cosine."""
    way = directions(x.shape[1])
    px, py = x @ way, y @ way
    i, j = _windows(px[:, 2], py[:, 2], width)
    if same:
        i, j = i[i < j], j[i < j]
    missed = np.zeros(len(i), dtype=np.int8)
    for k in [k for k in range(way.shape[1]) if k != 2]:
        missed += np.abs(px[i, k] - py[j, k]) > width
        live = missed <= way.shape[1] - need
        i, j, missed = i[live], j[live], missed[live]
    ok = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
    return i[ok], j[ok]


def _links(cosine: float, width: float, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, roots, links = [], [], []
            for left, right, same in zip(b.column("members").to_pylist(), b.column("others").to_pylist(),
                                         b.column("same").to_pylist()):
                x, y = (unit(np.stack([np.frombuffer(m["vec"], "<f8") for m in s])) for s in (left, right))
                i, j = near_pairs(x, y, same, cosine, width, need)
                if not len(i):
                    continue
                ids = [np.array([m["rep"] for m in s]) for s in (left, right)]
                n = [np.array([m["n"] for m in s]) for s in (left, right)]
                r, c = np.unique(i), np.unique(j)
                if same:
                    r = c = np.union1d(r, c)
                linked = np.zeros((len(r), len(c)), dtype=bool)
                linked[np.searchsorted(r, i), np.searchsorted(c, j)] = True
                rows, cols = _forest(linked, same)
                if same:
                    members, label = ids[0][r], rows
                else:
                    members, label = np.concatenate([ids[0][r], ids[1][c]]), np.concatenate([rows, cols])
                got = np.zeros(len(members), dtype=np.int64)
                shift = 0 if same else len(r)
                np.add.at(got, np.searchsorted(r, i), n[1][j])
                np.add.at(got, np.searchsorted(c, j) + shift, n[0][i])
                nodes.append(members)
                roots.append(members[label])
                links.append(got)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (nodes, roots, links)],
                                                 names=["u", "v", "links"])
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", cosine: float = COSINE, n_directions: int = DIRECTIONS,
                 spread: float = SPREAD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id_col, n_links, component_id), a row for each input row.

    Rows of one label (not null) and one dimension are linked if the cosine
    of their vectors is ``cosine`` or more.  ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest id that links
    reach, itself included.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null label, link with nothing.  Equal vectors are one
    class and link with each other; rows that repeat an id count as rows.  A
    null id is left out of the result's smallest ids.  Ids are integers.
    Other columns are ignored.  Empty table: empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = (F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
            & F.exists("vector", lambda x: x != 0) & F.col("__id").isNotNull())
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = scratch.put(rows.filter("good").groupBy("label", "vector")
                          .agg(F.min("__id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")

    width, need = calibrate(cosine, n_directions, spread, recall)
    cell = ["label", "dim", "c1", "c2"]
    label = StructField("label", vectors.schema[label_col].dataType)
    placed = scratch.put(classes.mapInArrow(_cells(width), StructType(
        [label, StructField("dim", IntegerType()), StructField("c1", IntegerType()), StructField("c2", IntegerType()),
         StructField("rep", LongType()), StructField("n", LongType()), StructField("vec", BinaryType())])), "placed")
    sizes = scratch.put(placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")),
                        "sizes")
    blocks = scratch.put(
        placed.join(sizes, cell)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .repartition(*cell, "part")  # not by the cell alone: a crowded cell's blocks go to many tasks
        .groupBy(*cell, "blocks", "part")
        .agg(F.collect_list(F.struct("rep", "n", "vec")).alias("members")), "blocks")
    steps = F.array(*[F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2"))
                      for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    asked = (blocks.withColumn("s", F.explode(steps))
             .select("label", "dim", (F.col("c1") + F.col("s.d1")).alias("c1"), (F.col("c2") + F.col("s.d2")).alias("c2"),
                     (F.expr("s.d1 = 0 AND s.d2 = 0")).alias("own"), F.col("part").alias("own_part"),
                     F.col("members").alias("left"))
             .join(sizes, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .filter("NOT own OR own_part <= part").drop("blocks"))
    met = asked.join(blocks.select(*cell, "part", F.col("members").alias("others")), cell + ["part"])
    links = scratch.put(met.select(F.col("left").alias("members"), "others",
                                   F.expr("own AND own_part = part").alias("same"))
                        .mapInArrow(_links(cosine, width, need), "u long, v long, links long"), "links")
    scratch.drop("placed", "sizes", "blocks")
    stars = components(links.select("u", "v"), scratch)
    near = links.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    told = scratch.put(
        classes.join(near, "rep", "left").join(stars.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                F.coalesce("root", "rep").alias("root")), "told")
    lone = F.lit(0).cast("long")
    return (rows.filter("good").join(told, ["label", "vector"])
            .select(F.col("__id").alias(id_col), F.col("links").alias("n_links"), F.col("root").alias("component_id"))
            .unionByName(rows.filter("NOT good").select(F.col("__id").alias(id_col), lone.alias("n_links"),
                                                        F.col("__id").alias("component_id"))))
