"""Substring dedup by level-wise doubling.

Level 1 looks at windows of half the length.  Of those only anchors are
compared: the windows with the least hash among all that lie in one full
window, so every full window holds an anchor and equal ones hold equal
anchors.  An anchor of one document alone rules out every full window around
it.  Level 2 doubles the survivors.  If all occurrences of an anchor stand in
the same surroundings (every full window around it alike), the smallest
document owns them and the others lose them.  Around the remaining anchors
each full window is compared by itself, by a 128-bit hash built from its two
halves.  No window that could matter is longer, so the doubling ends there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, arrow_schema, text_slices, utf8

WINDOW = 50
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits for each word, as two rows."""
    raw = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, 2).T)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of two neighbours, each lane on its own (splitmix finish)."""
    out = np.empty_like(x)
    for lane, odd in enumerate(_ODD):
        z = x[lane] * odd + (y[lane] ^ (y[lane] >> np.uint64(29)))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[lane] = z ^ (z >> np.uint64(31))
    return out


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by doubling."""
    n = h.shape[1] - size + 1
    if n <= 0:
        return h[:, :0]
    if size == 1:
        return h
    half = window_hashes(h, size // 2)
    out = _join(half[:, :half.shape[1] - size // 2], half[:, size // 2:])
    return _join(out[:, :n], h[:, size - 1:]) if size % 2 else out


def _sliding(x: np.ndarray, size: int, least) -> np.ndarray:
    """Least (or greatest) of every ``size`` neighbours, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = least(x[:len(x) - step], x[step:])
        have += step
    return x


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: half windows with the least hash in
    some full window (all of them where several tie)."""
    x = window_hashes(h, window // 2)[0]
    per = window - window // 2 + 1
    if h.shape[1] < window:
        return np.zeros(0, dtype=np.int64), x[:0]
    low = _sliding(x, per, np.minimum)
    pad = np.zeros(per - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([pad, low, pad]), per, np.maximum)
    at = np.flatnonzero(best == x)
    return at, x[at]


def surroundings(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words that the full windows around each anchor cover."""
    odd = np.uint64(0xD6E8FEB86659FD93)
    n = h.shape[1]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(3 * window, odd))
        lo = np.maximum(0, at - (window - window // 2))
        hi = np.minimum(n, at + window)
        mixed = _join(h, h)[1]
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(int((hi - lo).max()) if len(at) else 0):
            inside = lo + k < hi
            out[inside] += mixed[lo[inside] + k] * power[k]
        out = out * np.uint64(0xFF51AFD7ED558CCD) + (at - lo).astype(np.uint64) * np.uint64(1009) + (hi - at).astype(np.uint64)
        return out ^ (out >> np.uint64(32))


def _emit_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text"):
            rows, key, place, around = [], [], [], []
            for i, t in enumerate(utf8(b.column("__text"))):
                words = words_of(t)
                if len(words) < window:
                    continue
                h = word_hashes(words)
                at, x = anchors(h, window)
                rows.append(np.full(len(at), i))
                key.append(x)
                place.append(at)
                around.append(surroundings(h, at, window))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(pa.array(np.concatenate(rows))) for c in ("__id", "__row")]
                    + [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(place).astype(np.int32)),
                       pa.array(np.concatenate(around).view(np.int64))],
                    names=["__id", "__row", "anchor", "place", "around"])
    return run


def _emit_windows(window: int):
    back = window - window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text"):
            rows, first, second, place = [], [], [], []
            for i, (t, at) in enumerate(zip(utf8(b.column("__text")), b.column("places").to_pylist())):
                h = window_hashes(word_hashes(words_of(t)), window)
                start = np.array(at)[:, None] - np.arange(back + 1)[None, :]
                start = np.unique(start[(start >= 0) & (start < h.shape[1])])
                rows.append(np.full(len(start), i))
                first.append(h[0, start])
                second.append(h[1, start])
                place.append(start)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(pa.array(np.concatenate(rows))) for c in ("__id", "__row")]
                    + [pa.array(np.concatenate(x).view(np.int64)) for x in (first, second)]
                    + [pa.array(np.concatenate(place).astype(np.int32))],
                    names=["__id", "__row", "h1", "h2", "place"])
    return run


def _cut(window: int, schema):
    target = arrow_schema(schema)
    back = window - window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text"):
            kept, total, gone = [], [], []
            for t, around, exact in zip(utf8(b.column("__text")), b.column("around").to_pylist(),
                                        b.column("exact").to_pylist()):
                words = words_of(t)
                n = len(words)
                edge = np.zeros(n + 1, dtype=np.int64)
                for at, left, right in ((around, back, window), (exact, 0, window)):
                    if at:
                        p = np.array(at)
                        np.add.at(edge, np.maximum(0, p - left), 1)
                        np.add.at(edge, np.minimum(n, p + right), -1)
                drop = np.cumsum(edge[:-1]) > 0
                total.append(n)
                gone.append(int(drop.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~drop)).decode() if gone[-1]
                            else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                schema=target)
    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """(id_col, kept_text, n_words, n_removed), a row for each input row.

    Words are runs of characters other than ASCII white space.  A word goes
    if it lies in a run of ``window`` words whose sequence also starts in a
    row with a smaller ``id_col``; runs are judged on the input.  The kept
    words are joined by one space.

    Null and empty texts have no words.  Rows of one id don't remove each
    other's words.  A row with a null id keeps its words and removes none.
    Other columns are ignored.  Empty table: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"),
                       F.xxhash64(text_col).alias("__row"))  # tells rows of one id apart
    id_field = StructField("__id", docs.schema[id_col].dataType)
    key = [id_field, StructField("__row", LongType())]
    known = rows.filter("__id IS NOT NULL AND __text IS NOT NULL")

    found = scratch.put(known.mapInArrow(_emit_anchors(window), StructType(
        key + [StructField("anchor", LongType()), StructField("place", IntegerType()),
               StructField("around", LongType())])), "anchors")
    repeated = scratch.put(
        found.groupBy("anchor").agg(F.min("__id").alias("low"), F.max("__id").alias("high"),
                                    F.min("around").alias("a"), F.max("around").alias("z"))
        .filter("low < high").select("anchor", "low", (F.col("a") == F.col("z")).alias("alike")), "repeated")
    again = scratch.put(found.join(repeated, "anchor").filter("NOT alike OR __id > low")
                        .select("__id", "__row", "place", "alike"), "again")
    scratch.drop("anchors", "repeated")

    asked = (again.filter("NOT alike").groupBy("__id", "__row").agg(F.collect_set("place").alias("places")))
    windows = scratch.put(known.join(asked, ["__id", "__row"]).mapInArrow(_emit_windows(window), StructType(
        key + [StructField("h1", LongType()), StructField("h2", LongType()), StructField("place", IntegerType())])),
        "windows")
    owners = scratch.put(windows.groupBy("h1", "h2").agg(F.min("__id").alias("low"), F.max("__id").alias("high"))
                         .filter("low < high").select("h1", "h2", "low"), "owners")
    exact = (windows.join(owners, ["h1", "h2"]).filter("__id > low")
             .select("__id", "__row", "place", F.lit(False).alias("alike")))
    gone = scratch.put(again.filter("alike").unionByName(exact)
                       .groupBy("__id", "__row")
                       .agg(F.collect_set(F.when(F.col("alike"), F.col("place"))).alias("around"),
                            F.collect_set(F.when(~F.col("alike"), F.col("place"))).alias("exact")), "gone")
    scratch.drop("again", "windows", "owners")
    schema = StructType([id_field, StructField("kept_text", StringType()), StructField("n_words", LongType()),
                         StructField("n_removed", LongType())])
    return (rows.join(gone, ["__id", "__row"], "left").mapInArrow(_cut(window, schema), schema)
            .withColumnRenamed("__id", id_col))
