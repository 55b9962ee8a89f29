"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are joined first.  The distinct ones are laid out in
tiles by population count: a tile is the four counts of set bits of the four
16-bit quarters, cut into blocks of bounded size.  Two fingerprints that
differ in r bits have quarter counts that differ by r in all at most, so only
tile pairs within the radius are compared, block by block, with numpy's
exclusive-or and bit counts.  A block pair yields a spanning forest of its
links, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, text_slices, utf8
from .graph import components

BLOCK = 1024
SHINGLE_CHUNK = 1 << 16
QUARTERS = 4


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a UTF-8 text: a bit is 1 if it is set in more
    than half of the hashes of the ``words``-word shingles."""
    w = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    n = len(w) - words + 1
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, SHINGLE_CHUNK):
        bits = np.unpackbits(hashes[i:i + SHINGLE_CHUNK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text"):
            fp = np.array([fingerprint(t, words) for t in utf8(b.column("__text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(fp.view(np.int64))],
                                             names=["__id", "fp"])
    return run


def _forest(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows and columns of a link matrix: the lowest node of
    each one's component (rows first, then columns; ``same``: one set)."""
    n, m = linked.shape
    rows = np.arange(n)
    cols = rows if same else np.arange(n, n + m)
    while True:
        low = np.minimum(cols, np.where(linked, rows[:, None], n + m).min(axis=0))
        if same:
            low = np.minimum(low, np.where(linked, low[None, :], n + m).min(axis=1))
            if (low == rows).all():
                return rows, rows
            rows = cols = low
        else:
            new = np.minimum(rows, np.where(linked, low[None, :], n + m).min(axis=1))
            if (low == cols).all() and (new == rows).all():
                return rows, cols
            rows, cols = new, low


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            lists = [b.column("left"), b.column("right")]
            at = [x.offsets.to_numpy() for x in lists]
            flat = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in lists]
            for k, same in enumerate(b.column("same").to_pylist()):
                x, y = (flat[s][at[s][k]:at[s][k + 1]] for s in (0, 1))
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                sub = near[np.ix_(r, c)]
                rows, cols = _forest(sub, same)
                nodes = x[r] if same else np.concatenate([x[r], y[c]])
                label = rows if same else np.concatenate([rows, cols])
                own = np.flatnonzero(label != np.arange(len(label)))
                us.append(nodes[own])
                vs.append(nodes[label[own]])
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(z).view(np.int64)) for z in (us, vs)], names=["u", "v"])
    return run


def _tile(fp: str):
    quarter = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")))
               for i in range(QUARTERS)]
    return sum((q * F.lit(17 ** i) for i, q in enumerate(quarter)), F.lit(0)).cast("int")


def _near_tiles(tiles: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs (a, b), a <= b, of occupied tiles whose counts differ by
    ``radius`` in all at most.  There are 17^4 tiles, whatever the input."""
    there = set(tiles)
    split = {t: tuple(t // 17 ** i % 17 for i in range(QUARTERS)) for t in there}
    steps = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    out = []
    for t, q in split.items():
        for d in steps:
            p = [x + y for x, y in zip(q, d)]
            if min(p) >= 0 and max(p) <= 16:
                o = sum(x * 17 ** i for i, x in enumerate(p))
                if o >= t and o in there:
                    out.append((t, o))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(id_col, fp long, component_id), a row for each input row.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked;
    ``component_id`` is the smallest id that links reach, itself included.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  Texts of fewer than ``words`` words hash their whole word
    sequence.  Repeated rows share a fingerprint.  A null id is never the
    smallest one while its component holds another.  Other columns are
    ignored.  Empty table: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("__id", id_type), StructField("fp", LongType())])
    rows = scratch.put(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
                       .mapInArrow(_fingerprints(words), schema), "fingerprints")
    return (group_fingerprints(rows, scratch, radius, block)
            .select(F.col("__id").alias(id_col), "fp", "component_id"))


def group_fingerprints(rows: DataFrame, scratch: Scratch, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(__id, fp, component_id) from rows of (__id, fp long)."""
    spark = rows.sparkSession
    unique = scratch.put(rows.groupBy("fp").agg(F.min("__id").alias("rep")), "unique")

    placed = unique.select("fp", _tile("fp").alias("tile"))
    sizes = {r["tile"]: -(-r["n"] // block) for r in placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = F.broadcast(spark.createDataFrame(list(sizes.items()), "tile int, blocks int"))
    tiled = scratch.put(placed.join(cut, "tile")
                        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("part"))
                        .agg(F.collect_list("fp").alias("fps")), "tiles")
    pairs = spark.createDataFrame([(a, b, sizes[b]) for a, b in _near_tiles(list(sizes), radius)],
                                  "tile int, other int, blocks int")
    asked = (tiled.join(pairs, "tile")
             .select("tile", "part", F.col("fps").alias("left"), "other",
                     F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_part"))
             .filter("tile != other OR part <= other_part"))
    met = asked.join(tiled.select(F.col("tile").alias("other"), F.col("part").alias("other_part"),
                                  F.col("fps").alias("right")), ["other", "other_part"])
    edges = (met.select("left", "right", F.expr("tile = other AND part = other_part").alias("same"))
             .mapInArrow(_links(radius), "u long, v long"))
    stars = components(edges, scratch)
    rooted = scratch.put(unique.join(stars, unique["fp"] == stars["node"], "left")
                         .select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = scratch.put(rooted.join(least, "root").select("fp", "component_id"), "classes")
    scratch.drop("tiles", "unique", "rooted")
    return rows.join(classes, "fp").select("__id", "fp", "component_id")
