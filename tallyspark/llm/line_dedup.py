"""Line dedup by two Bloom filters.

Pass 1 puts the hash of every eligible line key into a filter of hashes seen
once; a hash that is already there goes into a filter of hashes seen twice.
Each building task keeps its own pair of filters; the pairs are merged in
segments, and a bit that two tasks set in their once-filters counts as seen
twice, so every key of two or more documents is in the merged twice-filter.
Pass 2 sends only the keys found in that filter ("suspects") through a
shuffle, as 256-bit digests, where documents are counted exactly and the
surviving document is chosen.  False positives cost a suspect row, never a
line: the result is exact at any filter size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, arrow_schema, text_slices

SPACE = " \t\n\x0b\x0c\r"
#: filter size: bits for each line, between the two bounds (a power of two).
BITS_PER_LINE = 16
MIN_BITS, MAX_BITS = 1 << 22, 1 << 28
SEGMENTS = 512


def line_key(line: str) -> str:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return line.strip(SPACE).encode().lower().decode()


def _keys(text: str, min_chars: int) -> set[bytes]:
    found = set()
    for line in text.split("\n"):
        s = line.strip(SPACE)
        if len(s) >= min_chars:
            found.add(s.encode().lower())
    return found


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """Two bit places for each key."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) * np.uint64(0x9E3779B1) + h >> np.uint64(7) & mask]
                    ).astype(np.int64)


def _build(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
        for b in text_slices(batches, "__text"):
            fresh: set[bytes] = set()
            again: set[bytes] = set()
            for t in b.column("__text").to_pylist():
                if t:
                    k = _keys(t, min_chars)
                    again |= fresh & k
                    fresh |= k
            if fresh:
                p = _places(list(fresh), bits)
                seen = once[p[0]] & once[p[1]]
                twice[p[:, seen].ravel()] = True
                once[p.ravel()] = True
            if again:
                twice[_places(list(again), bits).ravel()] = True
        if not once.any():
            return
        size = bits // SEGMENTS
        for s in range(SEGMENTS):
            at = slice(s * size, (s + 1) * size)
            if once[at].any():
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array([s], pa.int32()),
                     "once": pa.array([np.packbits(once[at]).tobytes()], pa.binary()),
                     "twice": pa.array([np.packbits(twice[at]).tobytes()], pa.binary())})
    return run


def _merge(rows):
    import pandas as pd

    once = twice = None
    for a, b in zip(rows["once"], rows["twice"]):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "twice": [twice.tobytes()]})


def _suspects(twice, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if twice.value is None:
            return
        flags = np.frombuffer(twice.value, np.uint8)

        def is_set(p: np.ndarray) -> np.ndarray:
            return (flags[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)

        for b in text_slices(batches, "__text"):
            ids, digests = [], []
            for i, t in zip(b.column("__id").to_pylist(), b.column("__text").to_pylist()):
                keys = list(_keys(t, min_chars)) if t else []
                if not keys:
                    continue
                p = _places(keys, bits)
                for j in np.flatnonzero(is_set(p[0]) & is_set(p[1])):
                    ids.append(i)
                    digests.append(hashlib.sha256(keys[j]).digest())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, b.schema.field("__id").type), pa.array(digests, pa.binary())],
                    names=["__id", "digest"])
    return run


def _rewrite(schema, carry: int, min_chars: int):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__text"):
            texts, total, gone = [], [], []
            for t, drop in zip(b.column("__text").to_pylist(), b.column("__drop").to_pylist()):
                lines = (t or "").split("\n")
                total.append(len(lines))
                if drop:
                    out = set(drop)
                    kept = []
                    for line in lines:
                        s = line.strip(SPACE)
                        if len(s) < min_chars or hashlib.sha256(s.encode().lower()).digest() not in out:
                            kept.append(line)
                    gone.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    gone.append(0)
                    texts.append(t or "")
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:carry], pa.array(texts, pa.string()), pa.array(total, pa.int64()),
                 pa.array(gone, pa.int64())], schema=target)
    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, min_docs: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: id_col), then kept_text, n_lines and
    n_dropped, a row for each input row.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that occur in ``min_docs``
    documents or more keep their lines only in the largest ``id_col``.

    Null or empty text: one empty line, kept text ''.  Rows of one id count
    as one document for a key; each such row is rewritten alike.  A row with
    null id keeps all its lines and counts for nothing.  Columns that are not
    carried are ignored.  Empty table: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    known = rows.filter(F.col("__id").isNotNull() & F.col("__text").isNotNull())

    n = known.agg(F.sum(F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1)).first()[0]
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_LINE * (n or 1)):
        bits *= 2
    # as many building tasks as cores: what they emit stays in proportion to the filter
    built = (known.select("__text").coalesce(spark.sparkContext.defaultParallelism)
             .mapInArrow(_build(bits, min_chars), "segment int, once binary, twice binary"))
    merged = built.groupBy("segment").applyInPandas(_merge, "segment int, twice binary").collect()
    flags = None
    if merged:  # at most MAX_BITS / 8 bytes, whatever the input
        whole = bytearray(bits // 8)
        size = bits // 8 // SEGMENTS
        for r in merged:
            whole[r["segment"] * size:(r["segment"] + 1) * size] = r["twice"]
        flags = bytes(whole)
    twice = spark.sparkContext.broadcast(flags)

    id_type = docs.schema[id_col].dataType
    suspects = scratch.put(known.mapInArrow(_suspects(twice, bits, min_chars),
                                            f"__id {id_type.simpleString()}, digest binary"), "suspects")
    repeated = scratch.put(suspects.groupBy("digest")
                           .agg(F.count_distinct("__id").alias("n"), F.max("__id").alias("keeper"))
                           .filter(F.col("n") >= min_docs).select("digest", "keeper"), "repeated")
    drop = (suspects.join(repeated, "digest").filter(F.col("__id") < F.col("keeper"))
            .groupBy("__id").agg(F.collect_set("digest").alias("__drop")))
    carry = carry or [id_col]
    schema = StructType([*(docs.schema[c] for c in carry), StructField("kept_text", StringType()),
                         StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    carried = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)],
                          F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return (carried.join(drop, "__id", "left")
            .select(*[f"__c{i}" for i in range(len(carry))], "__text", "__drop")
            .mapInArrow(_rewrite(schema, len(carry), min_chars), schema))
