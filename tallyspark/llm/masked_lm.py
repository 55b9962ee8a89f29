"""LM scoring by masked pseudo-likelihood.

A small network sees the words on both sides of a masked place, each through
the embedding table of its distance, and predicts the word there: first its
class, then the place in the class.  Frequent words have a place of their
own; the others share hashed places, and a word's chance within its place
comes from the counts of all words, with a reserve for words never counted.
A document's score is the sum of the conditional log-probabilities of all its
words.

Word counts come from the whole corpus, and the number of places grows with
it.  Training is data-parallel and in numpy: in each of a few rounds a
learner for each core streams its part of the documents, starting from the
common weights, and the weights are averaged by words seen; together the
rounds cover every document once.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from .common import Scratch, arrow_schema, hash_unit, text_slices, utf8
from .decontaminate import _WORDS

#: places of the smallest vocabulary (0: outside of the text; the last BUCKETS:
#: hashed rare words) and the counted words up to which it does, places in one
#: of its classes, words seen on each side, hidden units.
VOCAB, BUCKETS, VOCAB_WORDS, CLASS, SIDE, HIDDEN = 2048, 256, 1 << 22, 64, 3, 24
#: share of the documents that a round trains on, rounds (together: all, once),
#: words in a step at least and at most, steps for a slice of text, places
#: that stay together when a slice is shuffled.
SHARE, ROUNDS, STEP, MOST, STEPS, RUN, RATE = 0.25, 4, 512, 16384, 16, 64, 0.1
CHUNK, HELD_WORDS = 1 << 16, 400_000
#: numbers that are worked on at once, so that they stay in a core's cache.
NEAR = 1 << 16
#: words of a corpus that one learner trains on alone; beyond, learners grow
#: with the 3/4 power of the words.  Weights travel in slices of so many bytes.
LEARNER_WORDS, SLICE = 1 << 22, 1 << 18
#: counted words that every task holds; the counts of rarer ones are joined.
HELD_COUNTS = 1 << 18
#: joined log-probabilities are summed in whole steps of this size.
GRAIN = 1e-9


def _split(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, as ``words_of`` splits them; words in each."""
    joined = b" ".join([*(t or b"" for t in texts), b""]).translate(_WORDS)
    gap = np.frombuffer(joined, np.uint8) == 0x20
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, b" "))])
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def _distinct(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, which of them each word is, words in each text."""
    words, sizes = _split(texts)
    coded = words.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return (pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
                .select(["word", "n_sum"]).rename_columns(["word", "n"]))

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches()

    for b in text_slices(batches, "__text"):
        seen = _split(utf8(b.column("__text")))[0].value_counts()
        held.append(pa.table({"word": seen.field("values"), "n": seen.field("counts")}))
        if sum(t.num_rows for t in held) >= 2 * HELD_WORDS:
            held = [summed()]
            if held[0].num_rows >= HELD_WORDS:
                yield from told(held.pop())
    if held:
        yield from told(summed())


def places_for(words: int) -> tuple[int, int]:
    """Places of the vocabulary and of a class for a corpus of so many words:
    they grow with its fourth root and with the square root of that."""
    grown = VOCAB * max(1.0, words / VOCAB_WORDS) ** (1 / 4)
    each = CLASS * int(math.sqrt(grown / VOCAB))
    return -(-int(grown) // each) * each, each


def learners_for(words: int) -> int:
    """Parallel learners for a corpus of so many words: the same on any
    cluster.  Each one's share grows with the fourth root of the corpus."""
    return max(1, math.ceil((words / LEARNER_WORDS) ** (3 / 4)))


class _Ids(dict):
    """Word -> place in the vocabulary; rare words share hashed places."""

    def of(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Places of a text's words, and those of its words that share one."""
        out = np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        at = np.flatnonzero(out < 0)
        rare = [words[i] for i in at.tolist()]
        out[at] = np.fromiter(map(zlib.crc32, rare), dtype=np.uint32, count=len(rare)) % BUCKETS + self.first
        return out, rare

    def __init__(self, words: list[bytes], first: int):
        super().__init__({w: i + 1 for i, w in enumerate(words)})
        self.first = first

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word) % BUCKETS

    def __reduce__(self):
        return _Ids, (list(self), self.first)


class Tail:
    """ln p(word | its shared place).

    A counted word has its count, the reserve the number of the place's words
    counted once (one at least), each as a share of their sum.  The reserve is
    dealt out by spelling: independent bytes and an end, with the odds they
    have in the counted rare words.  So all words of a place have one at most.
    """

    def __init__(self, counts: dict[bytes, float], whole: bool, path: str | None,
                 totals: np.ndarray, once: np.ndarray, spelled: np.ndarray):
        self.counts = counts  # word -> ln of its count
        self.whole, self.path = whole, path  # no other word was counted, or: the table of all counts
        reserve = np.maximum(once, 1.0)
        self.all = np.log(totals + reserve)
        self.reserve = np.log(reserve) - self.all
        odds = (spelled + 1.0) / (spelled + 1.0).sum()  # 256 bytes, the end
        self.letters = np.log(odds)

    def unseen(self, word: bytes, place: int) -> float:
        spelling = self.letters[np.frombuffer(word, np.uint8)].sum() + self.letters[256]
        return float(self.reserve[place] + spelling)

    def known(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        """NaN: not among the held counts."""
        get, none = self.counts.get, math.nan
        found = np.fromiter(map(get, words, repeat(none)), dtype=np.float64, count=len(words))
        return found - self.all[places]


class Network:
    """Weights and the two passes through them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, seed: int = 3, each: int = CLASS):
        rng = np.random.default_rng(seed)
        size = len(counts)
        self.size, self.each = size, each
        self.ids = _Ids(words, size - BUCKETS)
        n = np.maximum(counts, 0.5)  # a place of its own for each count
        by_class = n.reshape(-1, each)
        self.w = {
            "see": (rng.standard_normal((2 * SIDE, size, HIDDEN)) * 0.1).astype(np.float32),
            "class": (rng.standard_normal((HIDDEN, size // each)) * 0.01).astype(np.float32),
            "class0": np.log(by_class.sum(axis=1) / n.sum()).astype(np.float32),
            "word": (rng.standard_normal((size // each, HIDDEN, each)) * 0.01).astype(np.float32),
            "word0": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32),
        }

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words, ``SIDE`` zeros around each text; words in each."""
        words, which, sizes = _distinct(texts)
        return self.padded(self.ids.of(words)[0][which], sizes), sizes

    @staticmethod
    def padded(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places) + SIDE * (len(sizes) + 1), dtype=np.int32)
        out[_places(sizes)[0]] = places
        return out

    def _sides(self) -> np.ndarray:
        """The tables of all sides, with a column that makes a one in
        ``_hidden``: 1 - 2 / (1 + exp(40)) is one exactly."""
        out = np.zeros((2 * SIDE, self.size, HIDDEN + 1), dtype=np.float32)
        out[..., :HIDDEN] = self.w["see"]
        out[0, :, HIDDEN] = 20
        return out

    @staticmethod
    def _hidden(around: np.ndarray, see: np.ndarray) -> np.ndarray:
        """Hidden units of all places in a row but ``SIDE`` at either end, for
        each row of ``around``, and a one for the constant of what follows."""
        around, n = around.astype(np.intp), around.shape[1] - 2 * SIDE
        h = np.take(see[0], around[:, :n], axis=0)
        for k, d in enumerate([*range(1 - SIDE, 0), *range(1, SIDE + 1)], 1):
            h += np.take(see[k], around[:, SIDE + d:SIDE + d + n], axis=0)
        h *= 2  # tanh by one exponential
        np.exp(h, out=h)
        h += 1
        np.divide(-2, h, out=h)
        h += 1
        return h

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """ln p(place of the word at each place | the words around it); the
        places ascend."""
        if not len(at):
            return np.empty(0, dtype=np.float32)
        see, h = self._sides(), np.empty((len(at), HIDDEN + 1), dtype=np.float32)
        for rows in _near(0, len(at), HIDDEN):
            mid = at[rows]
            h[rows] = np.take(self._hidden(ids[None, mid[0] - SIDE:mid[-1] + SIDE + 1], see)[0], mid - mid[0], axis=0)
        target = ids[at]
        order = _order(target, self.size)
        target, got = target[order], np.empty(len(at), dtype=np.float32)
        cuts = np.searchsorted(target, np.arange(0, self.size + 1, self.each))
        to_class = np.vstack([self.w["class"], self.w["class0"]])
        for j in np.flatnonzero(np.diff(cuts)):
            to_word = np.vstack([self.w["word"][j], self.w["word0"][j]])
            for rows in _near(cuts[j], cuts[j + 1], self.each):
                own = np.take(h, order[rows], axis=0)
                z = own @ to_class
                got[rows] = z[:, j] - np.log(_sums(np.exp(z)))
                z = own @ to_word
                got[rows] += z[np.arange(len(z)), target[rows] - j * self.each] - np.log(_sums(np.exp(z, out=z)))
        out = np.empty_like(got)
        out[order] = got
        return out

    def learn(self, ids: np.ndarray, at: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the words at ``at``."""
        at = at[_order(ids[at], self.size)]  # each class in a row
        sides = _beside(self.w)
        see = self._sides()
        run, number = at // RUN, np.zeros(len(ids) // RUN + 1, dtype=np.intp)
        number[run] = 1
        runs = np.flatnonzero(number)
        number[runs] = np.arange(len(runs))
        run = number[run]
        near = ids[np.minimum(np.maximum(runs[:, None] * RUN + np.arange(-SIDE, RUN + SIDE), 0), len(ids) - 1)]
        h1 = np.empty((len(runs), RUN, HIDDEN + 1), dtype=np.float32)
        for part in _near(0, len(runs), near.shape[1] * HIDDEN):
            h1[part] = self._hidden(near[part], see)
        h1, target = np.take(h1.reshape(-1, HIDDEN + 1), run * RUN + at % RUN, axis=0), ids[at]
        h = np.ascontiguousarray(h1[:, :HIDDEN])
        c, k = target // self.each, target % self.each
        p = _odds(h1, np.vstack([self.w["class"], self.w["class0"]]))
        p[np.arange(len(at)), c] -= 1
        back = np.zeros((len(at) + 1, HIDDEN), dtype=np.float32)  # and a row of zeros
        np.matmul(p, self.w["class"].T, out=back[:-1])
        self._move("class", ..., h.T @ p, memory)
        self._move("class0", ..., p.sum(axis=0), memory)
        cuts = np.searchsorted(c, np.arange(self.size // self.each + 1))
        live = np.flatnonzero(np.diff(cuts))
        word = np.empty((len(live), HIDDEN, self.each), dtype=np.float32)
        word0 = np.empty((len(live), self.each), dtype=np.float32)
        to_word = np.concatenate([self.w["word"][live], self.w["word0"][live, None]], axis=1)
        for i, j in enumerate(live):
            rows = slice(cuts[j], cuts[j + 1])
            p = _odds(h1[rows], to_word[i])
            p.reshape(-1)[np.arange(0, p.size, self.each) + k[rows]] -= 1
            back[rows] += p @ self.w["word"][j].T
            np.matmul(h[rows].T, p, out=word[i])
            np.add.reduce(p, axis=0, out=word0[i])
        self._move("word", live, word, memory)
        self._move("word0", live, word0, memory)
        back[:-1] *= 1 - h * h
        # all six sides of a run are shifts of one table; places outside have no weight
        filled = np.full((len(runs), RUN + 4 * SIDE), len(at))
        filled[run, at % RUN + 2 * SIDE] = np.arange(len(at))
        weights = np.take(back, filled, axis=0)
        cell = (np.arange(len(runs))[:, None] * (RUN + 4 * SIDE) + np.arange(SIDE, RUN + 3 * SIDE)).ravel()
        order = _order(near.ravel(), self.size)
        seen = near.ravel()[order]
        first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        rows, cell = seen[first], cell[order]  # only the rows that were seen
        # a place and its neighbours lie in a row: all sides are summed at once
        wide = np.lib.stride_tricks.as_strided(weights, (weights.shape[0] * weights.shape[1] - 2 * SIDE, (2 * SIDE + 1) * HIDDEN),
                                               (HIDDEN * weights.itemsize, weights.itemsize), writeable=False)
        sums = _Sums(first, cell).of(wide, SIDE).reshape(-1, 2 * SIDE + 1, HIDDEN)
        self._step(sides, rows, sums[:, [SIDE - d for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]].reshape(len(rows), -1), _beside(memory))

    def _move(self, name: str, part, g: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        self._step(self.w[name], part, g, memory[name])

    @staticmethod
    def _step(w: np.ndarray, part, g: np.ndarray, memory: np.ndarray) -> None:
        m = g * g
        m += memory[part]
        memory[part] = m
        g = RATE * g
        g /= np.sqrt(m, out=m)
        w[part] -= g

    def without_tail(self) -> Network:
        out = copy.copy(self)
        out.tail = None
        return out

    def fresh_memory(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(v, 0.1) for k, v in self.w.items()}


def _beside(w: dict[str, np.ndarray]) -> np.ndarray:
    """The tables of all sides with a word's rows in one, the same memory as
    ``w["see"]``, which is laid out so if it was not."""
    wide = w["see"].transpose(1, 0, 2)
    if not wide.flags.c_contiguous:
        wide = np.ascontiguousarray(wide)
        w["see"] = wide.transpose(1, 0, 2)
    return wide.reshape(len(wide), -1)


class _Sums:
    """``np.add.reduceat`` over the rows at ``cell``, bit for bit, with whole
    rows added side by side.  numpy adds a group's first row to the pairwise
    sum of the others: up to 7 one by one, up to 128 in eight sums that take
    turns, more in two halves, cut at a multiple of eight."""

    def __init__(self, first: np.ndarray, cell: np.ndarray):
        sizes = np.diff(np.append(first, len(cell)))
        self.cell, self.first, self.groups = cell, first, len(first)
        self.few = [(n, at) for n in range(1, 9) if len(at := np.flatnonzero(sizes == n))]
        self.long = np.flatnonzero(sizes > 8)
        starts, counts = first[self.long] + 1, sizes[self.long] - 1
        cut = np.flatnonzero(counts > 128)
        self.root = np.arange(len(self.long))
        more, self.halves = [], []  # blocks of cut groups; pairs of blocks to add
        for i in cut.tolist():
            self.root[i] = self._cut(int(starts[i]), int(counts[i]), len(starts), more)
        starts = np.append(starts, np.array([x for x, _ in more], dtype=np.int64))
        counts = np.append(counts, np.array([n for _, n in more], dtype=np.int64))
        counts[cut] = 0
        self.blocks = np.argsort(-counts, kind="stable")
        self.blocks = self.blocks[counts[self.blocks] > 0]
        self.starts, self.counts, self.slots = starts[self.blocks], counts[self.blocks], len(counts)

    def _cut(self, start: int, n: int, base: int, more: list) -> int:
        """The slot of a block's sum; a halved one has no rows of its own."""
        if n <= 128:
            more.append((start, n))
            return base + len(more) - 1
        half = n // 2 - n // 2 % 8
        pair = self._cut(start, half, base, more), self._cut(start + half, n - half, base, more)
        more.append((start, 0))
        self.halves.append((base + len(more) - 1, *pair))
        return base + len(more) - 1

    def of(self, weights: np.ndarray, off: int) -> np.ndarray:
        cell, width = self.cell - off, weights.shape[1]
        out = np.empty((self.groups, width), dtype=weights.dtype)
        for n, groups in self.few:
            for part in _near(0, len(groups), width):
                at = groups[part]
                first = self.first[at]
                total = weights[cell[first]]
                if n > 1:  # the first one is added last
                    rest = weights[cell[first + 1]]
                    for i in range(2, n):
                        rest += weights[cell[first + i]]
                    total += rest
                out[at] = total
        sums = np.empty((self.slots, width), dtype=weights.dtype)
        eight = np.arange(8)
        for part in _near(0, len(self.starts), 8 * width):
            starts, turns, left = self.starts[part], self.counts[part] // 8, self.counts[part] % 8
            r = weights[cell[starts[:, None] + eight]]
            for i, on in enumerate(np.searchsorted(-turns, -np.arange(1, turns[0])), 1):  # the largest blocks come first
                r[:on] += weights[cell[starts[:on, None] + (8 * i + eight)]]
            r = r[:, 0::2] + r[:, 1::2]
            r = r[:, 0::2] + r[:, 1::2]
            r = r[:, 0] + r[:, 1]
            order = np.argsort(-left, kind="stable")
            r, left, ends = r[order], left[order], (starts + 8 * turns)[order]
            for i, on in enumerate(np.searchsorted(-left, -np.arange(left[0]))):
                r[:on] += weights[cell[ends[:on] + i]]
            sums[self.blocks[part][order]] = r
        for into, a, b in self.halves:
            np.add(sums[a], sums[b], out=sums[into])
        out[self.long] = weights[cell[self.first[self.long]]] + sums[self.root]
        return out


def _near(start: int, end: int, width: int) -> Iterator[slice]:
    """The rows in slices of about ``NEAR`` numbers."""
    step = max(1, NEAR // width)
    return (slice(i, min(i + step, end)) for i in range(start, end, step))


def _order(keys: np.ndarray, size: int) -> np.ndarray:
    """The stable order of keys below ``size``: small ones are sorted in linear time."""
    return np.argsort(keys.astype(np.uint16) if size <= 1 << 16 else keys, kind="stable")


def _sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], dtype=z.dtype)


def _odds(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Softmax of each row of ``h @ to``; above 60 all are 60."""
    out, most = np.empty((len(h), to.shape[1]), dtype=h.dtype), np.exp(np.float32(60))
    with np.errstate(over="ignore"):
        for rows in _near(0, len(h), to.shape[1]):
            z = np.matmul(h[rows], to, out=out[rows])
            sums = _sums(np.exp(z, out=z))
            if sums.max() > most:
                sums = _sums(np.minimum(z, most, out=z))
            z /= sums[:, None]
    return out


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words in the padded sequence, and their text numbers."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) + SIDE * (doc + 1), doc


def _train(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, rng, seen, memory = shared.value, np.random.default_rng(seed), 0, None
        start = {k: v.copy() for k, v in net.w.items()}  # the worker may see the broadcast again
        for b in text_slices(batches, "__text"):
            ids, sizes = net.encode(utf8(b.column("__text")))
            at = _places(sizes)[0]
            memory = memory or net.fresh_memory()
            step = min(MOST, max(STEP, len(at) // STEPS))
            runs = len(ids) // RUN + 1
            at = at[_order(rng.permutation(runs)[at // RUN], runs)]
            for i in range(0, len(at), step):
                net.learn(ids, at[i:i + step], memory)
            seen += len(at)
        trained, net.w = net.w, start
        if seen:
            for name, w in trained.items():
                flat = w.tobytes()
                for k in range(0, len(flat), SLICE):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([k], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat[k:k + SLICE]], pa.binary())],
                        names=["name", "at", "seen", "weights"])
    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean of a slice, weighted by the words seen, in a fixed order."""
    rows = rows.sort_values(["weights", "seen"])
    total = float(rows["seen"].sum())
    mean = sum(np.frombuffer(w, np.float32) * np.float32(n / total) for w, n in zip(rows["weights"], rows["seen"]))
    return pd.DataFrame({"name": [rows["name"].iloc[0]], "at": [int(rows["at"].iloc[0])], "weights": [mean.astype(np.float32).tobytes()]})


def _merge(rows: DataFrame, learners: int) -> list:
    """Means of every slice of the weights in two steps, so that no task
    holds the slices of all learners."""
    parts = max(1, math.isqrt(learners))
    part = (rows.withColumn("part", F.pmod(F.xxhash64("weights"), F.lit(parts)))
            .groupBy("name", "at", "part").applyInPandas(
                lambda x: _average(x).assign(seen=int(x["seen"].sum()))[["name", "at", "seen", "weights"]],
                "name string, at long, seen long, weights binary"))
    got = part.groupBy("name", "at").applyInPandas(_average, "name string, at long, weights binary").collect()
    whole: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["name"], r["at"])):
        whole.setdefault(r["name"], []).append(r["weights"])
    return [{"name": name, "weights": b"".join(slices)} for name, slices in whole.items()]


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(257, dtype=np.int64)
    for b in batches:
        joined = b"".join(b.column("word").to_pylist())
        n[:256] += np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
        n[256] += b.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(n)], names=["byte", "n"])


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", share: float = SHARE,
          rounds: int = ROUNDS) -> Network:
    """The network for a corpus.  ``share`` of the documents, the next part
    in each round, trains it; null texts are left out.  The learners' number,
    documents and order follow from the corpus alone, so the scores do not
    depend on the cluster or the partitioning.  If some counts are not
    held (``HELD_COUNTS``), the table of all of them stays for ``score``."""
    spark = docs.sparkSession
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .filter("__text IS NOT NULL"))
    scratch = Scratch(spark, "lm")
    counts = scratch.put(rows.select("__text").mapInArrow(_count, "word binary, n long")
                         .groupBy("word").agg(F.sum("n").alias("n")), "counts")
    by_count = sorted(((r["n"], r["words"]) for r in
                       counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    every, least, held = sum(n * k for n, k in by_count), math.inf, 0
    for n, k in by_count:  # all words of a count are held, or none
        if held + k > HELD_COUNTS:
            break
        least, held = n, held + k
    whole = held == sum(k for _, k in by_count)
    size, each = places_for(every)
    top = counts.filter(F.col("n") >= (least if held else every + 1)).toArrow()
    top = sorted(zip((-x for x in top.column("n").to_pylist()), top.column("word").to_pylist()))
    own, rest = top[:size - BUCKETS - 1], top[size - BUCKETS - 1:]
    n = np.zeros(size)
    n[1:len(own) + 1] = [-x for x, _ in own]
    once = np.zeros(BUCKETS)
    last = F.lit(own[-1][0] * -1 if own else every + 1)  # among equal counts the words decide
    tail = counts.filter((F.col("n") < last) | ((F.col("n") == last) & (F.col("word") > F.lit(own[-1][1] if own else b""))))
    for r in (tail.groupBy(F.pmod(F.crc32("word"), F.lit(BUCKETS)).cast("int").alias("place"))
              .agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()):
        n[size - BUCKETS + r["place"]], once[r["place"]] = r["n"], r["once"]
    spelled = np.zeros(257)
    for r in (tail.select("word").mapInArrow(_spelled, "byte int, n long")
              .groupBy("byte").agg(F.sum("n").alias("n")).collect()):
        spelled[r["byte"]] = r["n"]
    net = Network([bytes(w) for _, w in own], n, each=each)
    net.tail = Tail({bytes(w): math.log(-x) for x, w in rest}, whole, None if whole else scratch.path("counts"),
                    n[size - BUCKETS:].copy(), once, spelled)
    if whole:
        scratch.drop("counts")
    unit = hash_unit("__id", salt=3)
    learners = learners_for(every)
    # documents of a learner and their order, on any cluster
    dealt = F.when(F.col("__id").isNull(), F.xxhash64(F.lit(5), "__text")).otherwise(F.xxhash64(F.lit(5), "__id"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(net.without_tail())
        part = rows.filter((F.pmod(unit - k * share, F.lit(1.0)) < share) | F.lit(share >= 1))
        got = _merge(part.select("__text", dealt.alias("__h"), F.pmod(dealt, F.lit(learners)).cast("int").alias("__slot"))
                     .repartitionById(learners, F.col("__slot")).sortWithinPartitions("__h", "__text")
                     .mapInArrow(_train(shared, k), "name string, at long, seen long, weights binary"), learners)
        for r in got:
            net.w[r["name"]] = np.frombuffer(r["weights"], np.float32).reshape(net.w[r["name"]].shape).copy()
        shared.unpersist()
    return net


def _scores(shared, schema):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tail, first = net.tail, net.size - BUCKETS
        for b in text_slices(batches, "__text"):
            words, which, sizes = _distinct(utf8(b.column("__text")))
            places, rare = net.ids.of(words)
            ids = net.padded(places[which], sizes)
            at, doc = _places(sizes)
            total = np.zeros(len(sizes))
            for i in range(0, len(at), CHUNK):
                total += np.bincount(doc[i:i + CHUNK], weights=net.log_probs(ids, at[i:i + CHUNK]),
                                     minlength=len(sizes))
            inner, shares = np.zeros(len(words)), places >= first
            inner[shares] = tail.known(rare, places[shares] - first)
            left: list[Counter] = [Counter() for _ in sizes]
            for i in np.flatnonzero(np.isnan(inner)[which]).tolist():
                left[doc[i]][words[which[i]], int(places[which[i]] - first)] += 1
            total += np.bincount(doc, weights=np.nan_to_num(inner)[which], minlength=len(sizes))
            asked = [[{"word": w, "n": n, "all": float(tail.all[p]), "unseen": tail.unseen(w, p)}
                      for (w, p), n in own.items()] for own in left]
            if tail.whole:
                total += [sum(x["n"] * x["unseen"] for x in own) for own in asked]
                asked = [[] for _ in sizes]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(sizes), pa.array(total),
                                              pa.array(asked, target.field(3).type)], schema=target)
    return run


#: words of a text whose counts are not held: how often, ln of their place's
#: sum, ln p if they were never counted.
ASKED = ArrayType(StructType([StructField("word", BinaryType()), StructField("n", LongType()),
                              StructField("all", DoubleType()), StructField("unseen", DoubleType())]))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, log_prob, mean_log_prob), a row for each input row:
    natural logarithms, the sum over all words of the whole text.

    Null, empty and wordless texts have no words, sum 0 and a null mean.
    Repeated rows score alike.  Other columns are ignored.  Empty table:
    empty result.  If the network doesn't hold all counts, the scores without
    the words it lacks are written when the frame is built.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    schema = StructType([StructField("__id", docs.schema[id_col].dataType), StructField("n_words", LongType()),
                         StructField("log_prob", DoubleType()), StructField("asked", ASKED)])
    out = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
           .mapInArrow(_scores(shared, schema), schema))
    if not net.tail.whole:
        # the counts of the scored corpus stay in their files; a row's number is fixed once written
        out = Scratch(spark, "lm-scores").put(out.withColumn("row", F.monotonically_increasing_id()), "scores")
        counts = spark.read.schema("word binary, n long").parquet(net.tail.path)
        counts = counts.select("word", F.col("n").alias("count"))
        each = out.select("row", F.explode("asked").alias("x")).select("row", "x.*")
        inner = F.coalesce(F.log("count") - F.col("all"), F.col("unseen"))
        sums = (each.join(counts, "word", "left").groupBy("row")
                .agg((F.sum(F.round(F.col("n") * inner / GRAIN).cast("long")) * F.lit(GRAIN)).alias("rest")))
        out = (out.join(sums, "row", "left")
               .withColumn("log_prob", F.col("log_prob") + F.coalesce("rest", F.lit(0.0))))
    return (out.select(F.col("__id").alias(id_col), "n_words", "log_prob")
            .withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))))
