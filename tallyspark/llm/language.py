"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of variable order, with counts of
the byte that follows.  The probability of a byte is found in the longest
context the language knows; an unseen byte escapes to the next shorter one
(as many escapes as distinct followers), where bytes already ruled out are
excluded, down to equal odds for all bytes never seen.  The counts are frozen
after training, so the code length of a byte depends on its context alone:
the trees of all languages are laid over each other and every node gets the
exact code length of every byte in every language.  A text's code length in a
language is the sum over its bytes; the shortest one names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_schema, hash_unit, text_slices, with_text

#: longest context in bytes; expected documents for each language in the
#: sample that the trees are fitted on; occurrences a context needs in a
#: language, and contexts that a language may have (the first is raised for
#: that language alone until they fit).
ORDER, SAMPLE_DOCS, LEAST, LANG_NODES = 3, 2000, 24, 6_000
#: languages whose trees are laid over each other; bytes of all code lengths
#: (they grow with the languages) that may be sent to the executors.
GROUP, MODEL_BYTES = 4, 1 << 30
STEP = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode()


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = b"\n" * order
        for b in text_slices(batches, "__text"):
            by: dict[str, list[bytes]] = {}
            for t, lang in zip(b.column("__text").to_pylist(), b.column("__lang").to_pylist()):
                if t:
                    by.setdefault(lang, []).append(_bytes(t))
            for lang, texts in by.items():
                data = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.int64)
                own = np.ones(len(data), dtype=bool)  # the padding is context only
                ends = np.cumsum([len(t) + order for t in texts])
                for k in range(order):
                    own[np.r_[0, ends[:-1]] + k] = False
                gram = np.zeros(len(data), dtype=np.int64)
                for k in range(order + 1):
                    gram[order:] |= data[order - k:len(data) - k] << (8 * k)
                values, n = np.unique(gram[own], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)],
                    names=["lang", "gram", "n"])
    return run


class Model:
    """The laid-over trees with the code lengths of every language."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int,
                 least: int, lang_nodes: int):
        self.langs, self.order = langs, order
        every = np.unique(np.concatenate([g for g, _ in grams.values()]))
        used = np.unique(np.concatenate([every >> (8 * k) & 255 for k in range(order + 1)]))
        self.code = np.zeros(256, dtype=np.int32)  # 0: a byte that no tree has seen
        self.code[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        own = [self._contexts(*grams[lang], order, least, lang_nodes) for lang in langs]
        levels = [np.unique(np.concatenate([o[k] for o in own])) for k in range(order + 1)]
        number = {(k, int(c)): i for i, (k, c) in enumerate((k, c) for k, cs in enumerate(levels) for c in cs)}
        nodes, sink = len(number), len(number)
        self.child = np.full((nodes + 1, width), sink, dtype=np.int32)
        parent = np.zeros(nodes, dtype=np.int64)
        for (k, c), i in number.items():
            if k:
                parent[i] = number[k - 1, c & ((1 << 8 * (k - 1)) - 1)]
                self.child[parent[i], self.code[c >> 8 * (k - 1)]] = i
        depth = np.array([k for k, _ in number])
        self.cost = np.empty((nodes * width, len(langs)), dtype=np.float32)
        for j, lang in enumerate(langs):
            g, n = grams[lang]
            counts = np.zeros((nodes, width))
            for k in [k for k in range(order + 1) if len(levels[k])]:
                ctx = g >> 8 & ((1 << 8 * k) - 1)
                at = np.searchsorted(levels[k], ctx)
                ok = np.isin(ctx, own[j][k])  # contexts of others are unknown here: as their parents
                np.add.at(counts, (at[ok] + sum(map(len, levels[:k])), self.code[g[ok] & 255]), n[ok])
            self.cost[:, j] = -np.log2(self._chances(counts, parent, depth)).ravel()
        self.width = width

    @staticmethod
    def _contexts(g: np.ndarray, n: np.ndarray, order: int, least: int, most: int) -> list[np.ndarray]:
        """The contexts of one language by length, ``most`` in all (and the
        empty one): those with enough occurrences, as many as their followers.
        A context's suffixes occur as often, so they are kept with it."""
        counted = []
        for k in range(1, order + 1):
            ctx, at = np.unique(g >> 8 & ((1 << 8 * k) - 1), return_inverse=True)
            counted.append((ctx, np.bincount(at, weights=n)))
        while sum(int((c >= least).sum()) for _, c in counted) > most:
            least = least * 5 // 4 + 1
        return [np.zeros(1, dtype=np.int64)] + [ctx[c >= least] for ctx, c in counted]

    @staticmethod
    def _chances(counts: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Probability of every byte after every context, with exclusion."""
        own = counts.copy()
        tail = np.empty_like(own)  # chances of the bytes a context has not seen, given an escape
        out = np.empty_like(own)
        for d in range(int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            if d:
                p = parent[at]
                unknown = counts[at].sum(axis=1) == 0  # the language lacks the context: as its parent
                seen, above = counts[at] > 0, own[p]
                left = np.where(seen, 0, above)
                n, q = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(left > 0, left / (n + q), np.where(q > 0, q / (n + q), 1) * tail[p])
                t[unknown] = tail[p[unknown]]
                own[at[unknown]] = above[unknown]
                tail[at] = t
            else:
                rest = 256 - (counts[at] > 0).sum(axis=1, keepdims=True)
                tail[at] = 1 / np.maximum(rest, 1)
            c = own[at]
            n, q = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[at] = np.where(c > 0, c / (n + q), np.where(n > 0, q / (n + q), 1) * tail[at])
        return np.maximum(out, 1e-30)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        pad = b"\n" * self.order
        data = self.code[np.frombuffer(pad + pad.join(texts) if texts else b"", np.uint8)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes + self.order) - sizes
        total = np.zeros((len(texts), len(self.langs)))
        sink = len(self.child) - 1
        flat = self.child.ravel()
        for lo in range(self.order, len(data), STEP):
            hi = min(len(data), lo + STEP)
            cur = np.zeros(hi - lo, dtype=np.int32)
            best = cur
            for d in range(1, self.order + 1):
                cur = flat[cur * self.width + data[lo - d:hi - d]]
                best = np.where(cur == sink, best, cur)
            bits = self.cost[best * self.width + data[lo:hi]]
            first = max(0, np.searchsorted(starts, lo, side="right") - 1)
            last = np.searchsorted(starts, hi, side="left")
            a = np.maximum(starts[first:last], lo) - lo
            z = np.minimum(starts[first:last] + sizes[first:last], hi) - lo
            some = np.flatnonzero(z > a)
            if len(some):
                cuts = np.stack([a[some], z[some]], axis=1).ravel()
                if cuts[-1] == hi - lo:
                    cuts = cuts[:-1]
                total[first + some] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)[::2]
        return total


class Models:
    """All languages, laid over each other in groups: a language's code
    lengths don't depend on the others, and the size grows with their number."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER,
                 least: int = LEAST, lang_nodes: int = LANG_NODES):
        self.langs, self.groups, size = langs, [], 0
        for i in range(0, len(langs), GROUP):
            part = langs[i:i + GROUP]
            self.groups.append(Model(part, {k: grams[k] for k in part}, order, least, lang_nodes))
            size += self.groups[-1].cost.nbytes + self.groups[-1].child.nbytes
            if size > MODEL_BYTES:
                raise ValueError(f"the trees of {len(langs)} languages take over {MODEL_BYTES} bytes on every executor; "
                                 "lower lang_nodes or raise MODEL_BYTES")

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([m.code_lengths(texts) for m in self.groups], axis=1)


def train(docs: DataFrame, text_col: str, lang_col: str, id_col: str, order: int = ORDER,
          sample_docs: int = SAMPLE_DOCS, least: int = LEAST, lang_nodes: int = LANG_NODES) -> Models | None:
    """Fits the trees on about ``sample_docs`` rows of each language, chosen
    by a hash of the id.  Rows with null text or language are left out; None
    if no row is left.  Repeated rows are picked together and count each.  A
    language's contexts don't depend on the other languages."""
    known = docs.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0) & F.col(lang_col).isNotNull())
    per = {r["l"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return None
    share: Column = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(sample_docs / n)) for k, n in per.items()])
    rows = (known.filter(hash_unit(id_col, salt=4) < share)
            .select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
            .mapInArrow(_count(order), "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    grams = {k: (v["gram"].to_numpy(), v["n"].to_numpy()) for k, v in rows.sort_values("gram").groupby("lang")}
    langs = sorted(grams)
    return Models(langs, grams, order, least, lang_nodes) if langs else None


def _predict(shared, carry: int, text: int, schema):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in text_slices(batches, text):
            texts = b.column(text).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            if at:
                bits = model.code_lengths([_bytes(texts[i]) for i in at])
                best = bits.argmin(axis=1)
                gap = bits - bits.min(axis=1, keepdims=True)
                chance = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
                for i, j, p in zip(at, best.tolist(), chance.tolist()):
                    pred[i], score[i] = model.langs[j], p
            yield pa.RecordBatch.from_arrays([*b.columns[:carry], pa.array(pred), pa.array(score, pa.float64())],
                                             schema=target)
    return run


def identify(docs: DataFrame, model: Models | None, carry: list[str] | None = None,
             text_col: str = "text") -> DataFrame:
    """The ``carry`` columns (default: doc_id), then lang_pred and score, a
    row for each input row.

    ``score`` is the probability of the language under equal priors.  Texts
    are read in lower case.  Null, empty and letterless texts, and all texts
    without a model, give ``und`` with score 0 (whole texts are read, however
    long); equal code lengths give the
    first language by name.  Repeated rows get a row each, with one answer.
    Empty table: empty result.  Columns that are not carried are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or ["doc_id"]
    schema = StructType([*(docs.schema[c] for c in carry),
                         StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    rows, text = with_text(docs, carry, text_col)
    return rows.mapInArrow(_predict(shared, len(carry), text, schema), schema)
