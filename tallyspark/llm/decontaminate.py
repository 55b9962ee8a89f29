"""Benchmark decontamination with an FM-index for each training shard.

The benchmark is the stated query set: its windows go to every task, in
blocks of bounded size.  A shard is a run of documents of one partition.  Its
words become symbols of the block's vocabulary; a word that no window holds
ends a segment, and segments shorter than the shortest window can't hold one,
so the index is built over the remaining segments alone.  All windows are
searched at once, backwards, through wavelet-matrix ranks; occurrences are
located by walking to sampled suffix positions, and the spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import arrow_schema, text_slices, utf8, with_text

WINDOW = 13
#: benchmark words in a block; symbols in a shard's index; distance of samples.
BLOCK_WORDS, SHARD_SYMBOLS, SAMPLE = 1 << 18, 1 << 20, 16

#: every byte that is not part of a word becomes a space, A-Z become a-z
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
               else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class FMIndex:
    """Backward search over ``symbols`` (non-negative integers).  Zero is a
    separator and the last symbol; every separator counts as a symbol of its
    own, below all others, in order of place, so no match crosses one."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        gaps = symbols == 0
        rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + int(gaps.sum()))
        order, k = np.argsort(rank, kind="stable"), 1
        while True:
            first = np.r_[0, np.diff(rank[order]) != 0] if k == 1 else first
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(first)
            if rank[order[-1]] == n - 1:
                break
            key = rank * (n + 1)
            key[:n - k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            first = np.r_[0, np.diff(key[order]) != 0]
            k *= 2
        self.n = n
        self.bwt = symbols[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(symbols))]
        self.sampled = np.where((order % sample == 0) | (self.bwt == 0), order, -1)
        self.levels = []
        seq = self.bwt
        for shift in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            bit = (seq >> shift & 1).astype(bool)
            ones = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, n - int(ones[-1])))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the first ``i`` places of the BWT."""
        start = np.zeros_like(i)
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            i, start = (np.where(one, zeros + ones[x], x - ones[x]) for x in (i, start))
        return i - start

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of the patterns (a row of symbols each)."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.flatnonzero(patterns.max(axis=1) < len(self.before) - 1)
        hi[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows, by steps back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(self.sampled[at] < 0)
        while len(todo):
            c = self.bwt[at[todo]].astype(np.int64)
            at[todo] = self.before[c] + self.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[self.sampled[at[todo]] < 0]
        return self.sampled[at] + steps


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[k], lo[k] + 1, ... (n[k] numbers) for each k, in one array."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - (ends - n), n)


class Block:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, words) in enumerate(items):
            s = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            for j in range(max(1, len(s) - window + 1)):
                found.setdefault(tuple(s[j:j + window]), set()).add(k)
        self.least = min(map(len, found))
        self.groups = []  # patterns of one length, then item numbers as offsets and values
        for m in sorted({len(w) for w in found}):
            ws = [w for w in found if len(w) == m]
            owners = [sorted(found[w]) for w in ws]
            self.groups.append((np.array(ws, dtype=np.int64), np.r_[0, np.cumsum([len(o) for o in owners])],
                                np.array([k for o in owners for k in o], dtype=np.int64)))

    def search(self, symbols: np.ndarray):
        """(start, length) of all occurrences, then (start, item number)."""
        index = FMIndex(symbols)
        spans, owned = [], []
        for patterns, offsets, owners in self.groups:
            lo, hi = index.find(patterns)
            n = hi - lo
            at = index.locate(_expand(lo, n))
            spans.append((at, np.full(len(at), patterns.shape[1])))
            which = np.repeat(np.arange(len(patterns)), n)
            per = offsets[which + 1] - offsets[which]
            owned.append((np.repeat(at, per), owners[_expand(offsets[which], per)]))
        return [np.concatenate(x) for x in zip(*spans)], [np.concatenate(x) for x in zip(*owned)]


class _Shard:
    """Documents gathered until their segments fill an index."""

    def __init__(self, block: Block):
        self.block, self.parts, self.size = block, [], 0

    def add(self, docs: list[list[bytes]], first: int) -> None:
        """Keeps the segments that can hold a window; ``first``: number of
        the first document in the shard."""
        get = self.block.vocab.get
        lengths = np.array([len(w) for w in docs], dtype=np.int64)
        ids = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        for s, w in zip(starts, docs):
            ids[s:s + len(w)] = np.fromiter(map(get, w, repeat(0)), dtype=np.int64, count=len(w))
        edge = np.flatnonzero(np.diff(np.r_[False, ids > 0].astype(np.int8)))
        a, z = edge[0::2], edge[1::2]
        long = z - a >= self.block.least
        a, z = a[long], z[long]
        keep = _expand(a, z - a + 1)
        if len(keep):
            doc = np.searchsorted(starts, keep, side="right") - 1
            self.parts.append((ids[keep], doc + first, keep - starts[doc]))
            self.size += len(keep)

    def hits(self) -> dict[int, tuple[list[tuple[int, int]], list]]:
        """By document number: merged spans of word numbers, items."""
        if not self.parts:
            return {}
        ids, doc, place = (np.concatenate(x) for x in zip(*self.parts))
        (at, n), (where, item) = self.block.search(ids)
        if not len(at):
            return {}
        cover = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        hit = np.cumsum(cover)[:-1] > 0
        out: dict[int, tuple[list, list]] = {}
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        for s, e in zip(edge[0::2], edge[1::2]):
            out.setdefault(int(doc[s]), ([], []))[0].append((int(place[s]), int(place[e - 1]) + 1))
        pairs = np.unique(np.stack([doc[where], item]), axis=1)
        for d, k in zip(*pairs.tolist()):
            out[d][1].append(self.block.items[k])
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scan(blocks, carry: int, text: int, schema, shard_symbols: int, shard_bytes: int = 64 << 20):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            found: dict[int, tuple[list, list]] = {}
            for sh in shards:
                for d, (spans, items) in sh.hits().items():
                    own = found.setdefault(d, ([], []))
                    own[0].extend(spans)
                    own[1].extend(items)
            d = 0
            for columns, counts in rows:
                spans, items = [], []
                for _ in counts:
                    s, k = found.get(d, ((), ()))
                    spans.append(_merged(list(s)))
                    items.append(sorted(set(k)))
                    d += 1
                hit = [sum(e - s for s, e in own) for own in spans]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()),
                     pa.array(items, target.field(carry + 2).type),
                     pa.array([[{"start": s, "end": e} for s, e in own] for own in spans],
                              target.field(carry + 3).type)], schema=target)

        held = [b.value for b in blocks]
        shards, rows, docs, size = [_Shard(b) for b in held], [], 0, 0
        for b in text_slices(batches, text):
            words = [words_of(t) for t in utf8(b.column(text))]
            for sh in shards:
                sh.add(words, docs)
            docs += b.num_rows
            columns = b.columns[:carry]
            rows.append((columns, [len(w) for w in words]))
            size += sum(c.nbytes for c in columns) + 64 * b.num_rows
            if size >= shard_bytes or any(sh.size >= shard_symbols for sh in shards):
                yield from flush()
                shards, rows, docs, size = [_Shard(b) for b in held], [], 0, 0
        if rows:
            yield from flush()
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None,
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       window: int = WINDOW, block_words: int = BLOCK_WORDS,
                       shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """The ``carry`` columns (default: doc_id), then n_words, n_hit, items and
    spans, a row for each document row.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower
    case.  A window is ``window`` consecutive words of an item (all words of
    a shorter one).  ``spans`` are the merged word ranges [start, end) inside
    occurrences of windows, ``n_hit`` their length, ``items`` the distinct
    ids of items with an occurring window.

    Null and empty texts have no words and no hits, on either side; an item
    without words has no window; items with a null id are left out.  Items
    may repeat or share windows; rows of documents that repeat are judged
    each.  Columns that are not carried are ignored.  An empty benchmark hits
    nothing, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks, held, size = [], [], 0

    def close():
        nonlocal held, size
        if held:
            blocks.append(spark.sparkContext.broadcast(Block(held, window)))
        held, size = [], 0

    chosen = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("binary").alias("t"))
    for r in chosen.filter("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        words = words_of(bytes(r["t"]))
        if words:
            held.append((r["i"], words))
            size += len(words)
        if size >= block_words:
            close()
    close()
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    carry = carry or ["doc_id"]
    schema = StructType([
        *(docs.schema[c] for c in carry), StructField("n_words", LongType()), StructField("n_hit", LongType()),
        StructField("items", ArrayType(benchmark.schema[item_col].dataType)),
        StructField("spans", ArrayType(span))])
    rows, text = with_text(docs, carry, text_col)
    return rows.mapInArrow(_scan(blocks, len(carry), text, schema, shard_symbols), schema)
