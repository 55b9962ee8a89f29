"""Quality classifier: hashed word n-grams, logistic regression by
follow-the-regularised-leader, scores as sparse dot products.

A text has three views: its words and punctuation runs (unigrams and
bigrams), and their shapes (one to three in a row), where a shape tells case,
digits and the punctuation itself, and whether a word repeats the one before.
Every n-gram is hashed to a slot; a view's value at a slot is the share of
its n-grams that fall there.  The labelled sample is dealt to a fixed number
of learners; each passes over its rows with per-coordinate FTRL steps, and
the mean of their weights is the model (at most ``SLOTS`` numbers).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_schema, text_slices
from .labelled import labelled_sample

SLOTS, SAMPLE_ROWS, LEARNERS, PASSES = 1 << 18, 16_000, 8, 4
RATE, SMOOTH, L1, L2 = 2.0, 1.0, 0.02, 0.02
CACHE = 1 << 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    if token.isdigit():
        return "9"
    if token.islower():
        return "a"
    if token.isupper():
        return "A" if len(token) > 1 else "I"
    return "Aa" if token[0].isupper() and token[1:].islower() else "mixed"


class _Tokens(dict):
    """Token -> its hash (upper 40 bits) and its shape's (lower 24)."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[token] = ((xxhash.xxh3_64_intdigest(token.lower()) >> 25 << 24)
                             | (xxhash.xxh3_64_intdigest(_shape(token)) >> 40)) & (1 << 63) - 1
        return out


_tokens = _Tokens()


def _slots(h: np.ndarray, view: int, slots: int) -> np.ndarray:
    z = (h ^ np.uint64(view * 0x51ED270B)) * _MIX
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def views(text: str, slots: int = SLOTS) -> list[np.ndarray]:
    """Slots of the n-grams of each view; a text without tokens has none."""
    found = _TOKEN.findall(text)
    t = np.fromiter(map(_tokens.__getitem__, found), dtype=np.int64, count=len(found)).view(np.uint64)
    if not len(t):
        return []
    word, shape = t >> np.uint64(24), t & np.uint64(0xFFFFFF)
    shape = shape.copy()
    shape[1:] ^= np.where(word[1:] == word[:-1], np.uint64(0x5A5A5A5A00), np.uint64(0))
    two = word[:-1] * _MIX + word[1:]
    s2 = shape[:-1] * _MIX + shape[1:]
    s3 = s2[:-1] * _MIX + shape[2:]
    return [np.concatenate([_slots(word, 1, slots), _slots(two, 2, slots)]),
            _slots(shape, 3, slots), _slots(np.concatenate([s2, s3]), 4, slots)]


def _sparse(text: str, slots: int) -> tuple[np.ndarray, np.ndarray]:
    v = [x for x in views(text, slots) if len(x)]
    if not v:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    at, inverse = np.unique(np.concatenate(v), return_inverse=True)
    share = np.concatenate([np.full(len(x), 1 / len(x)) for x in v])
    return at, np.bincount(inverse, weights=share)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; slot ``slots`` is the
    intercept, which is not regularised."""

    def __init__(self, slots: int, rate: float = RATE, smooth: float = SMOOTH, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)
        self.rate, self.smooth, self.l1, self.l2, self.slots = rate, smooth, l1, l2, slots

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1, l2 = (np.where(at == self.slots, 0.0, x) for x in (self.l1, self.l2))
        w = -(z - np.sign(z) * l1) / ((self.smooth + np.sqrt(n)) / self.rate + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.rate
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _learn(slots: int, passes: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__id", "__y"])
        data = []
        for t, y in zip(rows["__text"], rows["__y"]):
            at, x = _sparse(t, slots)
            data.append((np.append(at, slots), np.append(x, 1.0), int(y)))
        model, rng = Ftrl(slots), np.random.default_rng(seed)
        for _ in range(passes):
            for i in rng.permutation(len(data)):
                model.step(*data[i])
        w = model.weights(np.arange(slots + 1))
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at]})
    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          rows: int = SAMPLE_ROWS, slots: int = SLOTS, learners: int = LEARNERS, passes: int = PASSES) -> np.ndarray:
    """Weights (``slots`` and the intercept) from ``rows`` labelled documents
    at most; all zero without any."""
    sample = labelled_sample(docs, labels, label_col, rows, 2, id_col, text_col)
    parts = (sample.withColumn("part", F.pmod(F.xxhash64("__id"), F.lit(learners)))
             .groupBy("part").applyInPandas(_learn(slots, passes, 2), "slot long, w double"))
    # a slot that a learner left at zero counts as zero
    got = parts.groupBy("slot").agg((F.sum("w") / learners).alias("w")).toPandas()
    weights = np.zeros(slots + 1)
    weights[got["slot"].to_numpy(dtype=np.int64)] = got["w"].to_numpy(dtype=float)
    return weights


def _scores(shared, schema):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        slots = len(w) - 1
        for b in text_slices(batches, "__text"):
            out = np.full(b.num_rows, w[-1])
            for i, t in enumerate(b.column("__text").to_pylist()):
                for v in views(t or "", slots):
                    if len(v):
                        out[i] += w[v].mean()
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))],
                                             schema=target)
    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), a row for each input row: the probability of label 1.

    Null, empty and blank texts have no n-grams: the intercept alone scores
    them.  Other columns are ignored.  Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = StructType([StructField("__id", docs.schema[id_col].dataType), StructField("score", DoubleType())])
    return (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .mapInArrow(_scores(shared, schema), schema).withColumnRenamed("__id", id_col))
