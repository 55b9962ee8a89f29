"""K3 for vocabularies of any size: logistic regression whose coefficients
stay in a table.

No vector of vocabulary size exists on the driver or in a task.  The notes
are cut into blocks of rows, the vocabulary into shards of tokens.  A block
is laid out once as a sparse matrix over its own tokens.

The coefficients are zero at first and every gradient is a sum of rows, so
each vector of the optimiser is the notes' matrix times a weight of every row
and category: a block keeps those weights and the vector's margins on its own
rows, which give all scalar products.  Only a gradient is added up over the
vocabulary: a block sends the shards the sums of those tokens that other
blocks hold too, the shards send the totals back and keep nothing.  The
state is written in the shared folder after every step, the layout once, so a
lost executor's part is read again.

The optimiser is L-BFGS in its vector-free form: the driver sees scalar
products of the vectors alone (a dozen numbers).  Margins are linear in the
step, so the line search tries all steps in one pass over the margins.
"""

from __future__ import annotations

import contextlib
import json
import math
import re
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import py_round
from ..session import discard, ensure_checkpoint_dir, materialize

#: rows of a fit's block at most and at least, of a block to predict, bytes of
#: a block at most, rows that are split into words at once, tokens of a shard
ROWS_PER_KEY, LEAST_ROWS, PREDICT_ROWS, BLOCK_BYTES, SPLIT_ROWS, SHARD = 1 << 14, 1 << 10, 1 << 12, 1 << 26, 1 << 11, 1 << 15
HISTORY = 6
STEPS = [2.0 ** -k for k in range(-1, 11)]
WORD = re.compile(r"\w\w+", re.ASCII)
# workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ShardedModel(NamedTuple):
    """(token, idf, w) and what all rows share: categories and intercepts."""
    coefficients: DataFrame
    labels: list[str]
    intercepts: list[float]
    losses: list[float]


class Layout(NamedTuple):
    """The laid out notes: blocks, where their tokens are in the shards, rows
    of each category, distinct tokens and the shards' number."""
    blocks: DataFrame
    links: DataFrame
    counts: dict[str, int]
    block_ids: list[int]
    size: int
    shards: int


# --- words and matrices of a block -------------------------------------------

def _words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the text of each word (two characters of a-z, 0-9 and _ at
    least, in lower case)."""
    text = text.cast(pa.string()).fill_null("")
    odd = pc.match_substring_regex(text, "[^a-z0-9_ ]")
    if pc.any(odd).as_py():
        text = pc.replace_with_mask(text, odd, pa.array([" ".join(WORD.findall(x.lower())) for x in text.filter(odd).to_pylist()], pa.string()))
    split = pc.split_pattern(text, " ")
    words, row = split.flatten(), pc.list_parent_indices(split)
    keep = pc.greater_equal(pc.binary_length(words), 2)
    return row.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64), words.filter(keep)


def _counted(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens, each row's number of them, and row after row their
    places and how often they occur."""
    names, lens, cols, tfs = [], [], [], []
    for at in range(0, len(text), SPLIT_ROWS):
        part = text.slice(at, SPLIT_ROWS)
        row, words = _words(part)
        words = words.dictionary_encode()
        size = max(len(words.dictionary), 1)
        key = row * size + words.indices.to_numpy()
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        names.append(words.dictionary)
        lens.append(np.bincount(key[first] // size, minlength=len(part)))
        cols.append(key[first] % size)
        tfs.append(np.diff(first, append=len(key)))
    every = pa.concat_arrays(names).dictionary_encode() if names else pa.array([], pa.string()).dictionary_encode()
    place = np.split(every.indices.to_numpy(), np.cumsum([len(x) for x in names])[:-1]) if names else []
    col = np.concatenate([p[c] for p, c in zip(place, cols)] or [np.zeros(0)]).astype(np.int32)
    tf = np.concatenate(tfs or [np.zeros(0)])
    small = not len(tf) or tf.max() < 256
    return every.dictionary, np.concatenate(lens or [np.zeros(0)]).astype(np.int32), col, tf.astype(np.uint8 if small else np.uint32)


def _shard_of(tokens: pa.Array, shards: int) -> np.ndarray:
    """A hash of each token, the same in every process."""
    tokens = tokens.cast(pa.string())
    if not len(tokens):
        return np.zeros(0, np.int32)
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends.astype(np.int64) - ends[0]
    lens = np.diff(ends)
    powers = np.cumprod(np.full(lens.max() + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(ends[:-1], lens)], out=sums[1:])
    h = sums[ends[1:]] - sums[ends[:-1]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(shards)).astype(np.int32)


def _packed(codec: str | None = None, **columns) -> bytes:
    batch = pa.record_batch(list(columns.values()), names=list(columns))
    return _stream(pa.Table.from_batches([batch]), codec)


def _stream(table: pa.Table, codec: str | None = None) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packed: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def _array(column: pa.ChunkedArray, kind: type, at: int = 0) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), kind)


def _entries(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' lengths, columns and counts of a block as it was laid out."""
    col, tf = (_unpacked(block[x][0].as_buffer())[x].to_numpy() for x in ("col", "tf"))
    return _array(block["lens"], np.int32), col, tf


def _slices(tokens: pa.Array, shards: int, **columns: np.ndarray) -> list[dict]:
    """The tokens and what belongs to them, packed for each shard."""
    shard = _shard_of(tokens, shards)
    order = np.argsort(shard, kind="stable")
    ids, first = np.unique(shard[order], return_index=True)
    ends = [*first[1:], len(order)]
    tokens, columns = tokens.take(pa.array(order)), {x: v[order] for x, v in columns.items()}
    return [{"shard": int(i), "part": _packed(token=tokens.slice(a, b - a), **{x: pa.array(v[a:b]) for x, v in columns.items()})}
            for i, a, b in zip(ids, first, ends)]


SLICES = "slices array<struct<shard: int, part: binary>>"
SLICE = pa.list_(pa.struct([("shard", pa.int32()), ("part", pa.binary())]))
BLOCK = "__block long, lens binary, col binary, tf binary, " + SLICES


def _lay_out(text: str, rows: int, shards: int, extra: Callable[[pa.Table], dict], count: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows that a task reads one after another: how often each row
    has each of the block's tokens, and the tokens by shard, with ``count``
    also how many rows have them."""
    def block(key: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        tokens, lens, col, tf = _counted(table[text].combine_chunks())
        having = {"n": np.bincount(col, minlength=len(tokens)).astype(np.int32)} if count else {}
        parts = _slices(tokens, shards, loc=np.arange(len(tokens), dtype=np.int32), **having)
        columns = {"__block": pa.array([key], pa.int64()), "lens": [lens.tobytes()], "col": [_packed("zstd", col=pa.array(col))], "tf": [_packed("zstd", tf=pa.array(tf))],
                   "slices": pa.array([parts], SLICE)} | extra(table)
        return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, rows - sum(x.num_rows for x in held)))
                batch = batch.slice(held[-1].num_rows)
                if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= BLOCK_BYTES:
                    yield block(key, held)
                    key, held = key + 1, []
        if held:
            yield block(key, held)
    return run


def _labels(table: pa.Table) -> dict:
    codes = table["label"].combine_chunks().dictionary_encode()
    y = codes.indices.to_numpy().astype(np.int32)
    return {"names": pa.array([codes.dictionary.to_pylist()], pa.list_(pa.string())),
            "seen": pa.array([np.bincount(y, minlength=len(codes.dictionary)).tolist()], pa.list_(pa.int64())), "y": [y.tobytes()]}


class _Matrix:
    """A block's notes: tf-idf with rows of unit length.  Its sums go over
    slices of rows, whose numbers stay in a core's cache."""

    def __init__(self, lens: np.ndarray, col: np.ndarray, tf: np.ndarray, idf: np.ndarray, norm: np.ndarray | None = None):
        self.lens, self.col, self.tf, self.idf = lens, col, tf, idf
        self.ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        self.step = max(1, (len(lens) << 18) // max(len(col), 1))
        if norm is None:
            norm = np.zeros(len(lens))
            for a, z, col, tf in self._parts():
                x = tf * idf[col]
                norm[a:z] = np.sqrt(self._of_rows(x * x, a, z))
        self.norm = norm

    def _parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for a in range(0, len(self.lens), self.step):
            z = min(a + self.step, len(self.lens))
            at = slice(self.ends[a], self.ends[z])
            yield a, z, self.col[at].astype(np.intp), self.tf[at].astype(np.float64)

    def _of_rows(self, x: np.ndarray, a: int, z: int) -> np.ndarray:
        out = np.zeros(z - a)
        full = np.flatnonzero(self.lens[a:z])
        if len(full):
            out[full] = np.add.reduceat(x, self.ends[a:z][full] - self.ends[a])
        return out

    def _by_length(self, x: np.ndarray) -> np.ndarray:
        return np.divide(x, self.norm[:, None], out=np.zeros_like(x), where=self.norm[:, None] > 0)

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        """The rows added up, each token's with its values: (categories, tokens)."""
        rows = np.ascontiguousarray(self._by_length(rows).T)
        out = np.zeros((len(rows), len(self.idf)))
        for a, z, col, tf in self._parts():
            for i, x in enumerate(rows):
                x = np.repeat(x[a:z], self.lens[a:z])
                x *= tf
                out[i] += np.bincount(col, x, minlength=len(self.idf))
        out *= self.idf
        return out

    def add(self, out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """``tokens`` of the entries ``at`` alone, added to ``out``."""
        rows, col, of = self._by_length(rows), self.col[at], np.searchsorted(self.ends, at, side="right") - 1
        for i in range(len(out)):
            np.add.at(out[i], col, rows[of, i] * self.tf[at] * self.idf[col])

    def rows(self, w: np.ndarray) -> np.ndarray:
        """Each row's margins, from the tokens' coefficients (categories, tokens)."""
        out, w = np.empty((len(self.lens), len(w))), w * self.idf
        for a, z, col, tf in self._parts():
            x = np.empty(len(col))
            for i in range(len(w)):
                np.take(w[i], col, out=x, mode="clip")
                x *= tf
                out[a:z, i] = self._of_rows(x, a, z)
        return self._by_length(out)


def _chances(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of each row and the logarithm of its sum."""
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _direction(dots: dict, basis: list[str], pairs: list[tuple[str, str]]) -> dict[str, float]:
    """Coefficients over ``basis`` of L-BFGS's direction, from scalar products."""
    def product(a: dict, b: str) -> float:
        return sum(c * dots[min(x, b), max(x, b)] for x, c in a.items())

    d = {"g": -1.0}
    alpha = {}
    for s, y in reversed(pairs):
        alpha[s] = product(d, s) / dots[min(s, y), max(s, y)]
        d[y] = d.get(y, 0.0) - alpha[s]
    if pairs:
        s, y = pairs[-1]
        scale = dots[min(s, y), max(s, y)] / dots[y, y]
        d = {x: c * scale for x, c in d.items()}
    for s, y in pairs:
        beta = product(d, y) / dots[min(s, y), max(s, y)]
        d[s] = d.get(s, 0.0) + alpha[s] - beta
    return {x: d.get(x, 0.0) for x in basis}


# --- the layout of a fit -----------------------------------------------------

LINKS = "shard int, __block long, size int, loc binary, at binary, idf binary, own binary, words binary"
LINK = pa.schema([("shard", pa.int32()), ("__block", pa.int64()), ("size", pa.int32()), *[(x, pa.binary()) for x in ("loc", "at", "idf", "own", "words")]])


def _number(n: int):
    """A shard's tokens in order: to each block their places and idf and
    whether no other block has them; block -1: the words."""
    def run(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("__block")
        got = [_unpacked(x.as_buffer()) for x in parts["part"]]
        tokens = pa.concat_arrays([x["token"].combine_chunks() for x in got]).dictionary_encode()
        order = pc.sort_indices(tokens.dictionary).to_numpy()
        words = tokens.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        at = place[tokens.indices.to_numpy()]
        df = np.bincount(at, np.concatenate([x["n"].to_numpy() for x in got]), minlength=len(words))
        idf, own = np.log((1.0 + n) / (df + 1.0)) + 1.0, np.bincount(at, minlength=len(words)) == 1
        shard, rows = parts["shard"][0].as_py(), []
        rows.append((shard, -1, len(words), None, None, idf.tobytes(), None, _packed(token=words)))
        for b, x, a in zip(parts["__block"].to_pylist(), got, np.split(at, np.cumsum([len(x) for x in got])[:-1])):
            rows.append((shard, b, len(a), x["loc"].to_numpy().tobytes(), a.tobytes(), idf[a].tobytes(), own[a].tobytes(), None))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), LINK)], schema=LINK)
    return run


def lay_out(train: DataFrame, text: str = "clean_notes", label: str = "category", partitions: int | None = None,
            rows_per_key: int = ROWS_PER_KEY, rows: int | None = None) -> Layout:
    """The labelled notes as blocks, written once; ``train`` is read once more
    to count its rows, unless ``rows`` says about how many there are."""
    spark = train.sparkSession
    train = train.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    rows = train.count() if rows is None else rows
    slots, parts = spark.sparkContext.defaultParallelism, partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # larger blocks exchange less, but there are two for every core
    per_block = min(rows_per_key, max(LEAST_ROWS, -(-rows // (2 * slots))))
    shards = max(min(parts, 2 * slots), -(-rows // ROWS_PER_KEY))
    # a task reads one block if it can
    train = train.coalesce(slots * -(-rows // (ROWS_PER_KEY * slots))) if rows > ROWS_PER_KEY * slots else train
    laid = materialize(train.mapInArrow(_lay_out("text", per_block, shards, _labels), f"{BLOCK}, names array<string>, seen array<long>, y binary"), "blocks")
    counts: dict[str, int] = {}
    ids = []
    for r in laid.select("__block", "names", "seen").collect():
        ids.append(r["__block"])
        for x, m in zip(r["names"], r["seen"]):
            counts[x] = counts.get(x, 0) + m
    if not counts:
        raise ValueError("no labelled rows")
    with _clean_shuffles(spark):
        links = materialize(laid.select("__block", F.inline("slices")).repartition(shards, "shard")
                            .groupBy("shard").applyInArrow(_number(sum(counts.values())), LINKS), "links")
    size = links.filter("__block < 0").agg(F.sum("size")).first()[0] or 0
    return Layout(laid, links, dict(sorted(counts.items())), sorted(ids), size, shards)


MATRIX = ("__block long, y binary, lens binary, col binary, tf binary, idf binary, norm binary, shards array<int>, locs array<binary>, "
          "ats array<binary>, own_shards array<int>, own_locs array<binary>, own_ats array<binary>")


def _settle(keys: dict[int, int], labels: list[str]):
    """A block with its tokens' idf and their places in the shards: of those
    that other blocks have too, and of its own."""
    index = {x: i for i, x in enumerate(labels)}

    def run(block: pa.Table, links: pa.Table) -> pa.Table:
        links = links.sort_by("shard")
        size = sum(links["size"].to_pylist())
        idf = np.empty(size)
        sent: dict[str, list] = {x: [] for x in ("shards", "locs", "ats", "own_shards", "own_locs", "own_ats")}
        for i, shard in enumerate(links["shard"].to_pylist()):
            loc, at = _array(links["loc"], np.int32, i), _array(links["at"], np.int32, i)
            own = _array(links["own"], np.bool_, i)
            idf[loc] = _array(links["idf"], np.float64, i)
            for kind, which in (("", ~own), ("own_", own)):
                if which.any():
                    for x, v in ((f"{kind}shards", shard), (f"{kind}locs", loc[which].tobytes()), (f"{kind}ats", at[which].tobytes())):
                        sent[x].append(v)
        codes = np.array([index[x] for x in block["names"][0].as_py()], np.int32)
        y = codes[_array(block["y"], np.int32)]
        lens, col, tf = _entries(block)
        norm = _Matrix(lens, col, tf, idf).norm
        columns = {"__block": pa.array([keys[block["__block"][0].as_py()]], pa.int64()), "y": [y.tobytes()],
                   "lens": [lens.tobytes()], "col": [col.tobytes()], "tf": [tf.tobytes()], "idf": [idf.tobytes()], "norm": [norm.tobytes()],
                   **{x: pa.array([v], pa.list_(pa.int32() if x.endswith("shards") else pa.binary())) for x, v in sent.items()}}
        return pa.table(columns)
    return run


# --- steps of the optimiser --------------------------------------------------

# Vectors add up to zero over the categories (residuals do), so the last
# category is left out of all that is kept and sent.

def _by_key(key: int) -> int:
    return key


def _loaded(row: Row) -> tuple[int, dict]:
    """A block's matrix and its tokens' places in the shards."""
    def ints(x: bytes) -> np.ndarray:
        return np.frombuffer(bytes(x), np.int32)

    tf = bytes(row["tf"])
    block = {"y": ints(row["y"]), "lens": ints(row["lens"]), "col": ints(row["col"]),
             "tf": np.frombuffer(tf, np.uint8 if 4 * len(tf) == len(row["col"]) else np.uint32),
             "idf": np.frombuffer(bytes(row["idf"]), np.float64), "norm": np.frombuffer(bytes(row["norm"]), np.float64)}
    for kind in ("", "own_"):
        block[f"{kind}sent"] = [(shard, ints(loc), ints(at)) for shard, loc, at in zip(*(row[f"{kind}{x}"] for x in ("shards", "locs", "ats")))]
    own = np.ones(len(block["idf"]), bool)
    for _, loc, _ in block["sent"]:
        own[loc] = False
    # entries of tokens that no other block has
    block["own"] = np.flatnonzero(own[block["col"]]).astype(np.int32)
    return row["__block"], block


def _matrix(block: dict) -> _Matrix:
    return _Matrix(*(block[x] for x in ("lens", "col", "tf", "idf", "norm")))


def _start(k: int):
    def run(block: dict) -> dict:
        zeros = np.zeros((len(block["y"]), k - 1))
        return {"y": block["y"], "m": {"w": zeros}, "alpha": {"w": zeros}, "dots": [], "rest": []}
    return run


def _combined(vectors: dict[str, np.ndarray], c: dict[str, float]) -> np.ndarray | float:
    return sum(f * vectors[x] for x, f in c.items())


def _whole(x: np.ndarray) -> np.ndarray:
    """With the last category."""
    return np.column_stack([x, -x.sum(axis=1)])


def _line(c: dict[str, float], bias: list[float], bias_d: list[float]):
    """A block's losses after each of ``STEPS``."""
    def run(state: dict) -> list[float]:
        y, at, d = state["y"], _whole(state["m"]["w"]) + np.array(bias), _whole(_combined(state["m"], c)) + np.array(bias_d)
        every, losses = np.arange(len(y)), []
        for t in STEPS:
            z = at + t * d
            losses.append(float((_chances(z)[1] - z[every, y]).sum()))
        return losses
    return run


def _residuals(state: dict, c: dict[str, float], t: float, bias: list[float]) -> tuple[np.ndarray, float]:
    """Softmax less one at the row's category, after the step, and the rows' loss."""
    z, y = _whole(state["m"]["w"] + t * _combined(state["m"], c)) + np.array(bias), state["y"]
    p, log_sum = _chances(z)
    every = np.arange(len(y))
    p[every, y] -= 1.0
    return p, float((log_sum - z[every, y]).sum())


def _together(items: Iterator[tuple]) -> Iterator[tuple[int, dict, dict, dict]]:
    """A partition's blocks with their state and what the shards sent."""
    found: dict[int, list[dict]] = {}
    for key, value in items:
        at = found.setdefault(key, [{}, {}, {}])
        if isinstance(value, tuple):
            at[2][value[0]] = value[1]
        else:
            at["m" in value] = value
    for key, (block, state, sums) in found.items():
        yield key, block, state, sums


def _gradient(c: dict[str, float], t: float, bias: list[float]):
    """A block's sums of its tokens, in slices for the shards."""
    def run(items: Iterator[tuple]) -> Iterator[tuple]:
        for key, block, state, _ in _together(items):
            g = _matrix(block).tokens(_residuals(state, c, t, bias)[0][:, :-1])
            for shard, loc, at in block["sent"]:
                yield shard, (key, at, g[:, loc])
    return run


def _coefficients(items: Iterator[tuple]) -> Iterator[tuple]:
    """A block's part of the coefficients, also of tokens that no other block has."""
    for key, block, state, _ in _together(items):
        w = _matrix(block).tokens(state["alpha"]["w"])
        for shard, loc, at in block["sent"] + block["own_sent"]:
            yield shard, (key, at, w[:, loc])


def _totals(parts: Iterator[tuple]) -> Iterator[tuple[int, list[tuple], np.ndarray]]:
    """The shards' parts and their sums: (categories, tokens)."""
    found: dict[int, list[tuple]] = {}
    for shard, part in parts:
        found.setdefault(shard, []).append(part)
    for shard, got in found.items():
        got.sort(key=lambda x: x[0])  # a fixed order of the sums
        total = np.zeros((len(got[0][2]), max(int(at.max()) for _, at, _ in got) + 1))
        for _, at, g in got:
            for i in range(len(g)):
                total[i][at] += g[i]  # a block has a token once
        yield shard, got, total


def _back(parts: Iterator[tuple]) -> Iterator[tuple]:
    """To each block, the totals of its tokens."""
    for shard, got, total in _totals(parts):
        for key, at, _ in got:
            yield key, (shard, total[:, at])


def _named(parts: Iterator[tuple]) -> Iterator[tuple]:
    """A shard's coefficients in the order of its tokens, of all categories."""
    for shard, _, w in _totals(parts):
        yield shard, _whole(w.T).tobytes()


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.vdot(a, b) + a.sum(axis=1) @ b.sum(axis=1))


def _take(c: dict[str, float], t: float, n: int, bias: list[float], keep: list[str], new: tuple[str, str] | None, want: list[tuple[str, str]]):
    """A block after the step: weights and margins of the new vectors, its
    part of the scalar products, of the loss and of the intercepts' gradient."""
    def run(items: Iterator[tuple]) -> Iterator[tuple]:
        for key, block, state, sums in _together(items):
            x = _matrix(block)
            r, loss = _residuals(state, c, t, bias)
            total = np.zeros((r.shape[1] - 1, len(x.idf)))
            for shard, loc, _ in block["sent"]:
                for i, w in enumerate(sums[shard]):
                    total[i][loc] = w
            x.add(total, r[:, :-1], block["own"])
            after = {"y": state["y"], "rest": [loss, *r.sum(axis=0).tolist()]}
            for kind, g in (("m", x.rows(total)), ("alpha", r[:, :-1])):
                old = state[kind]
                step = t * _combined(old, c)
                w = old["w"] + step
                g = g / n + w / n
                after[kind] = {v: old[v] for v in keep} | {"w": w, "g": g}
                if new:
                    after[kind] |= {new[0]: step, new[1]: g - old["g"]}
            after["dots"] = [_dot(after["alpha"][a], after["m"][b]) for a, b in want]
            yield key, after
    return run


def _join_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards' tokens with their idf and coefficients."""
    for batch in batches:
        for words, idf, w in zip(batch["words"], batch["idf"], batch["w"]):
            token = _unpacked(words.as_buffer())["token"].combine_chunks()
            w = np.frombuffer(w.as_buffer(), np.float64)
            ends = np.linspace(0, len(w), len(token) + 1).astype(np.int32)
            yield pa.record_batch([token, pa.array(np.frombuffer(idf.as_buffer(), np.float64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(w))],
                                  names=["token", "idf", "w"])


@contextlib.contextmanager
def _clean_shuffles(spark: SparkSession):
    """A table's shuffle files go when it is written, not when the driver
    happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _forget(state: RDD) -> None:
    """Remove a state that no step reads any more."""
    path, sc = state.getCheckpointFile(), state.ctx
    state.unpersist()
    if path:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def fit_sharded(train: DataFrame, text: str = "clean_notes", label: str = "category", max_iter: int = 1000,
                tol: float = 1e-4, partitions: int | None = None, rows_per_key: int = ROWS_PER_KEY) -> ShardedModel:
    """K3: the model of ``train_category_model`` (smoothed tf-idf, unit
    length, multinomial loss, L2 penalty 1/n on all but the intercepts),
    fitted without a driver-sized vector.

    Stops after ``max_iter`` iterations or when the loss improves by less than
    ``tol`` of itself.  Rows without a label are left out; a null text has no
    tokens.  Every step writes its state in the shared folder.  Only the
    categories, their intercepts and the blocks' numbers are lists on the driver.
    """
    return fit_laid_out(lay_out(train, text, label, partitions, rows_per_key), max_iter, tol)


def fit_laid_out(layout: Layout, max_iter: int = 1000, tol: float = 1e-4) -> ShardedModel:
    """``fit_sharded`` on laid out notes; their tables are removed."""
    spark = layout.blocks.sparkSession
    ensure_checkpoint_dir(spark)
    labels, n, sc = list(layout.counts), sum(layout.counts.values()), spark.sparkContext
    k, parts = len(labels), len(layout.block_ids)
    with _clean_shuffles(spark):
        keys = {x: i for i, x in enumerate(layout.block_ids)}
        settled = materialize(layout.blocks.drop("slices", "seen").groupBy("__block").cogroup(layout.links.filter("__block >= 0").drop("words").groupBy("__block"))
                              .applyInArrow(_settle(keys, labels), MATRIX), "matrix")
        words = materialize(layout.links.filter("__block < 0").select("shard", "idf", "words"), "words")
    discard(layout.blocks)
    discard(layout.links)
    # a partition for each block: with its state, only sums are shuffled
    blocks = settled.rdd.map(_loaded).partitionBy(parts, _by_key).persist(StorageLevel.MEMORY_AND_DISK)

    def kept(state: RDD) -> RDD:
        return state._reserialize(blocks._jrdd_deserializer).persist(StorageLevel.MEMORY_AND_DISK)

    prior = [math.log(c / n) for c in layout.counts.values()]
    bias = [p - sum(prior) / k for p in prior]

    def tried(c: dict, t: float, bias: list[float], keep: list[str], new, want) -> tuple[RDD, float, list[float], list[float]]:
        """The state after a step, the mean loss, the intercepts' gradient and
        the scalar products wanted."""
        sums = sc.union([blocks, state]).mapPartitions(_gradient(c, t, bias)).partitionBy(min(layout.shards, parts), _by_key)
        back = sums.mapPartitions(_back).partitionBy(parts, _by_key)
        after = kept(sc.union([blocks, state, back]).mapPartitions(_take(c, t, n, bias, keep, new, want), preservesPartitioning=True))
        after.checkpoint()
        products, rest = [0.0] * len(want), [0.0] * (1 + k)
        for _, x, y in sorted(after.map(lambda x: (x[0], x[1]["dots"], x[1]["rest"])).collect()):
            products, rest = [a + b for a, b in zip(products, x)], [a + b for a, b in zip(rest, y)]
        back._jrdd.rdd().cleanShuffleDependencies(False)
        _forget(state)
        return after, rest[0] / n, [x / n for x in rest[1:]], products

    state = kept(blocks.mapValues(_start(k)))
    try:
        pairs: list[tuple[str, str]] = []
        dots: dict = {}
        want = [("g", "g"), ("w", "w"), ("g", "w")]
        state, loss, bias_g, got = tried({}, 0.0, bias, [], None, want)
        ww = got[1]
        own = {("g", "g"): got[0], ("g", "w"): got[2]}  # scalar products without the intercepts

        def product(a: str, c: dict) -> float:
            return sum(v * own[min(a, x), max(a, x)] for x, v in c.items())

        side = {"g": bias_g}          # the intercepts' part of every vector
        dots["g", "g"] = got[0] + sum(x * x for x in bias_g)
        losses = [loss + got[1] / (2 * n)]
        for serial in range(max_iter):
            basis = [x for p in pairs for x in p] + ["g"]
            c = _direction(dots, basis, pairs)
            slope = sum(v * dots[min(x, "g"), max(x, "g")] for x, v in c.items())
            if not slope < 0:
                break
            bias_d = [sum(c[x] * side[x][i] for x in basis) for i in range(k)]
            s, y = f"s{serial}", f"y{serial}"
            older = pairs[-(HISTORY - 1):]
            names = [x for p in [*older, (s, y)] for x in p]
            want = sorted({(min(a, b), max(a, b)) for a in (s, y, "g") for b in [*names, "g"]}
                          | {(min(a, "w"), max(a, "w")) for a in [*names, "g", "w"]})
            line = [x for _, x in sorted(state.mapValues(_line(c, bias, bias_d)).collect())]
            line = np.sum(line, axis=0).tolist()
            # the penalty of each step from scalar products with w
            wd, dd = product("w", c), sum(v * product(x, c) for x, v in c.items())
            full = {t: line[j] / n + (ww + 2 * t * wd + t * t * dd) / (2 * n) for j, t in enumerate(STEPS)}
            fine = [t for t in STEPS if full[t] <= losses[-1] + 1e-4 * t * slope]
            if not fine:
                break
            t = min(fine, key=lambda t: full[t])
            bias = [b + t * d for b, d in zip(bias, bias_d)]
            state, loss, new_bias_g, got = tried(c, t, bias, [x for p in older for x in p], (s, y), want)
            side[s], side[y] = [t * d for d in bias_d], [a - b for a, b in zip(new_bias_g, bias_g)]
            side["g"] = bias_g = new_bias_g
            for (a, b), x in zip(want, got):
                own[a, b] = x
                if "w" not in (a, b):
                    dots[a, b] = x + sum(u * v for u, v in zip(side[a], side[b]))
            ww = own["w", "w"]
            pairs = older + ([(s, y)] if dots[min(s, y), max(s, y)] > 0 else [])
            losses.append(full[t])
            if abs(losses[-2] - losses[-1]) <= tol * max(abs(losses[-1]), 1e-12):
                break
        w = sc.union([blocks, state]).mapPartitions(_coefficients).partitionBy(min(layout.shards, parts), _by_key).mapPartitions(_named)
        with _clean_shuffles(spark):
            coefficients = materialize(words.join(spark.createDataFrame(w, "shard int, w binary"), "shard")
                                       .select("idf", "words", "w").mapInArrow(_join_words, "token string, idf double, w array<double>"), "coefficients")
        w._jrdd.rdd().cleanShuffleDependencies(False)
    finally:
        blocks.unpersist()
        blocks._jrdd.rdd().cleanShuffleDependencies(False)
        _forget(state)
    discard(settled)
    discard(words)
    return ShardedModel(coefficients, labels, bias, losses)


# --- prediction --------------------------------------------------------------

def _deal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch["w"]
            width = len(w[0]) if len(w) else 0
            w = w.flatten().to_numpy().reshape(len(batch), width)
            parts = _slices(batch["token"], shards, idf=batch["idf"].to_numpy(), row=np.arange(len(batch), dtype=np.int32))
            for x in parts:
                x["w"] = w[_unpacked(pa.py_buffer(x["part"]))["row"].to_numpy()].tobytes()
            if parts:
                yield pa.record_batch([pa.array([x[c] for x in parts], t) for c, t in (("shard", pa.int32()), ("part", pa.binary()), ("w", pa.binary()))], names=["shard", "part", "w"])
    return run


def _look_up(k: int):
    """To each block, idf and coefficients of those of its tokens that the
    model has."""
    def run(parts: pa.Table, model: pa.Table) -> pa.Table:
        known = [_unpacked(x.as_buffer()) for x in model["part"]]
        out = {"__block": [], "loc": [], "idf": [], "w": []}
        if known:
            words = pa.concat_arrays([x["token"].combine_chunks() for x in known])
            idf = np.concatenate([x["idf"].to_numpy() for x in known])
            w = np.concatenate([np.frombuffer(x.as_buffer(), np.float64).reshape(-1, k) for x in model["w"]])
            for block, part in zip(parts["__block"].to_pylist(), parts["part"]):
                part = _unpacked(part.as_buffer())
                at = pc.index_in(part["token"].combine_chunks(), words)
                has = at.is_valid().to_numpy(zero_copy_only=False)
                at = at.drop_null().to_numpy()
                for c, v in (("__block", block), ("loc", part["loc"].to_numpy()[has].tobytes()), ("idf", idf[at].tobytes()), ("w", w[at].tobytes())):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64() if c == "__block" else pa.binary()) for c, v in out.items()})
    return run


def predict_sharded(model: ShardedModel, df: DataFrame, text: str = "clean_notes", known: list[str] | None = None,
                    fallback: str = "Other") -> DataFrame:
    """K4 with a sharded model: ``df`` with ``predicted_category`` and its
    probability (3 decimals), as ``predict_category`` gives them.  Each block
    of rows gets the coefficients of its own tokens, so neither its words nor
    sums for its rows are shuffled."""
    spark, k, columns, intercepts = df.sparkSession, len(model.labels), df.columns, np.array(model.intercepts, np.float64)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-model.coefficients.count() // SHARD))

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        docs = _unpacked(block["rows"][0].as_buffer())
        lens, col, tf = _entries(block)
        size = int(col.max()) + 1 if len(col) else 0
        idf, w = np.zeros(size), np.zeros((k, size))  # words that the model has not count for nothing
        for i in range(len(got)):
            loc = _array(got["loc"], np.int32, i)
            idf[loc] = _array(got["idf"], np.float64, i)
            w[:, loc] = _array(got["w"], np.float64, i).reshape(-1, k).T
        p = _chances(_Matrix(lens, col, tf, idf).rows(w) + intercepts)[0]
        return (docs.append_column("__at", pa.array(p.argmax(axis=1).astype(np.int32))).append_column("__top", pa.array(p.max(axis=1))))

    laid = materialize(df.mapInArrow(_lay_out(text, PREDICT_ROWS, shards, lambda table: {"rows": [_stream(table, "zstd")]}, count=False), f"{BLOCK}, rows binary"), "unlabelled")
    table = model.coefficients.select("token", "idf", "w").mapInArrow(_deal(shards), "shard int, part binary, w binary")
    got = (laid.select("__block", F.inline("slices")).groupBy("shard").cogroup(table.groupBy("shard"))
           .applyInArrow(_look_up(k), "__block long, loc binary, idf binary, w binary"))
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema.fields], StructField("__at", IntegerType()), StructField("__top", DoubleType())])
    out = laid.drop("slices").groupBy("__block").cogroup(got.groupBy("__block")).applyInArrow(run, schema)
    pred = F.get(F.array(*map(F.lit, model.labels)), F.col("__at"))
    pred = F.when(pred.isin(model.labels if known is None else known), pred).otherwise(F.lit(fallback))
    return out.select(*columns, pred.alias("predicted_category"), py_round("__top", 3).alias("confidence"))


def save_sharded(model: ShardedModel, path: str) -> None:
    """The coefficients as a table, then what all rows share."""
    spark = model.coefficients.sparkSession
    model.coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
    shared = json.dumps([model.labels, model.intercepts, model.losses])
    spark.createDataFrame([(shared,)], "shared string").write.mode("overwrite").parquet(f"{path}/metadata")


def load_sharded(spark: SparkSession, path: str) -> ShardedModel:
    shared = json.loads(spark.read.parquet(f"{path}/metadata").first()["shared"])
    return ShardedModel(spark.read.parquet(f"{path}/coefficients"), *shared)
