"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised, and those longer than a sequence are cut so that all
pieces but the first are full.  The pieces are range-sorted by length.  Then,
from the longest length down, rounds of a bulk-synchronous best fit: all
waiting pieces of the length sweep over the open gaps in ascending order from
the length's successor, equal claims on a gap are resolved by rank, the gaps
shrink, and the sweep repeats; pieces that fit no gap open new sequences.

Lengths and gaps are integers up to the sequence length, so pieces of one
length, and gaps of one size that were opened together, are interchangeable:
a sweep moves whole runs, (length, first rank, number), and their number
depends on the sequence length alone.  A piece finds its place by its rank in
the distributed order; no row passes the driver.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import Scratch, arrow_schema, text_slices

CAPACITY, END_ID = 1024, 2
#: words a task keeps with their ids before it starts afresh
CACHE = 1 << 19

#: Split pattern of the byte-level vocabulary, and the bytes
#: that its token strings show as themselves (the others follow from 256 on).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
_PROBE = ["", " ", "a  b", "It's 12 o'clock,\n\n the  end.\t", "déjà vu 中文 \U0001f600!!", " x y "]


class Encoder:
    """Ids of the tokenizer file for whole texts, as little-endian bytes.

    The ids are those of ``tokenizers`` without added special tokens: a
    special token's string in a text is that token, unless
    ``special_as_text``, which reads it as ordinary text.  Where the file is a byte-level BPE whose merges
    rank as their ids, the pieces between spaces are encoded one by one with
    the same merges and remembered: no token spans a space that follows other
    text, as a split takes one space along with what comes after it.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        # texts that hold a token of this list go through the tokenizer whole
        self.marks = [t.content for t in self.whole.get_added_tokens_decoder().values() if not (t.special and special_as_text)]
        self.fast = self._fast(path)
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _fast(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type", "BPE") != "BPE":
            return None
        hidden = [b for b in range(256) if b not in set(SHOWN)]
        byte_of = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        try:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            joined = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            order = [model["vocab"][a + b] for a, b in joined]
        except KeyError:
            return None
        if order != sorted(order):
            return None
        fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return fast if all(np.array(fast(t), dtype="<u4").tobytes() == self._slow(t) for t in _PROBE) else None

    def _piece(self, cache: dict[str, bytes], key: str, text: str) -> bytes:
        if len(cache) >= CACHE:
            cache.clear()
        out = cache[key] = np.array(self.fast(text), dtype="<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(m in text for m in self.marks):
            return self._slow(text)
        # a space inside a run of white space is no cut
        if ("   " in text or "  \n" in text or "\n  " in text or "\n \n" in text
                or text.endswith(("  ", "\n ")) or _OTHER_SPACE.search(text)):
            return np.array(self.fast(text), dtype="<u4").tobytes()
        words = text.split(" ")
        head, get = words[0], self.rest.get
        out = [self.first.get(head) or self._piece(self.first, head, head)]
        out += [get(w) or self._piece(self.rest, w, " " + w) for w in words[1:]]
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    return Encoder(path, special_as_text)


def _pieces(path: str, capacity: int, end_id: int, schema, with_ids: bool, special_as_text: bool):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special_as_text).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in text_slices(batches, "__text"):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, t in enumerate(b.column("__text").to_pylist()):
                data = (encode(t) if t else b"") + end
                n = len(data) // 4
                at = 0
                for j in range(-(-n // capacity)):
                    to = at + ((n - 1) % capacity + 1 if j == 0 else capacity)
                    part = data[4 * at:4 * to]
                    doc.append(k)
                    piece.append(j)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at = to
            cols = [b.column("__id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, target.field("ids").type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)
    return run


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (first rank, number, first sequence, offset) over pieces ranked
    from the longest length down; piece rank + k goes to sequence + k."""
    gaps: list[int] = []  # sizes of open gaps, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap size -> (first sequence, number)
    out, rank, opened = [], 0, 0
    for length in sorted(counts, reverse=True):
        waiting = counts[length]
        while waiting:
            k = bisect_left(gaps, length)  # the successor: the tightest gap that takes the length
            if k == len(gaps):
                new = -(-waiting // (capacity // length))
                runs.setdefault(capacity, []).append((opened, new))
                insort(gaps, capacity)
                opened += new
                continue
            gap = gaps[k]
            first, n = runs[gap].pop()
            take = min(n, waiting)
            out.append((rank, take, first, capacity - gap))
            if take < n:
                runs[gap].append((first + take, n - take))
            if not runs[gap]:
                del runs[gap]
                gaps.pop(k)
            if gap > length:
                if gap - length not in runs:
                    insort(gaps, gap - length)
                runs.setdefault(gap - length, []).append((first, take))
            rank += take
            waiting -= take
    return out


def _place(shared, schema):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, (ranks, _, sequences, offsets) = shared.value
        for b in batches:
            at = b.column("__at").to_numpy()
            rank = before[at >> 33] + (at & ((1 << 33) - 1))
            k = np.searchsorted(ranks, rank, side="right") - 1
            cols = {"sequence_id": pa.array(sequences[k] + rank - ranks[k]), "offset": pa.array(offsets[k])}
            yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else b.column(f.name) for f in target],
                                             schema=target)
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset),
    a row for each piece of each input row.

    A document is its ids by the tokenizer file plus ``end_id``; only one of
    more than ``capacity`` ids is cut, and its first piece takes what full
    pieces leave.  ``ids_crc32`` is the crc32 of the piece's ids as
    little-endian unsigned 32-bit numbers, ``ids`` the ids themselves.  The
    string of a special token is that token, or ordinary text with
    ``special_as_text``.  The
    pieces of a sequence fill it from offset 0 without gaps.

    Null and empty texts are the end id alone.  Repeated rows are packed
    each; a null id is kept as null.  Other columns are ignored.  Empty
    table: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    fields = [StructField("__id", docs.schema[id_col].dataType), StructField("piece", IntegerType()),
              StructField("start", LongType()), StructField("length", LongType()),
              StructField("ids_crc32", LongType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    schema = StructType(fields)
    pieces = scratch.put(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
                         .mapInArrow(_pieces(tokenizer, capacity, end_id, schema, with_ids, special_as_text), schema), "pieces")
    order = [F.col("length").desc(), F.col("__id"), F.col("piece"), F.col("ids_crc32")]
    ranked = scratch.put(pieces.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
                         .sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    scratch.drop("pieces")
    per = {r["p"]: r["n"] for r in ranked.groupBy(F.shiftright("__at", 33).alias("p"))
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.cumsum([0] + [per.get(p, 0) for p in range(max(per, default=0) + 1)])
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, capacity)
    shared = spark.sparkContext.broadcast((before, np.array(plan, dtype=np.int64).reshape(-1, 4).T))
    out = StructType(fields + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(_place(shared, out), out).withColumnRenamed("__id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_docs) from the result of ``pack(with_ids=True)``;
    a sequence holds ``capacity`` ids at most, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"), F.count(F.lit(1)).alias("n_docs"))
            .select("sequence_id", F.flatten("p.ids").alias("ids"), "n_docs"))
