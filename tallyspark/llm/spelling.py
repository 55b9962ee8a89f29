"""Spelling variants by finite-state composition.

The pairs of vocabulary words one edit apart are the pairs that the machine
``A . E . A`` accepts: the minimised acceptor A of the vocabulary, a
transducer E of one insertion or replacement, and A again.  A state of the
composed machine is (state of A, edits so far, state of A).  The work is
divided by initial states.  Of two near words the shorter has n letters, and
the edit lies either behind its first n // 2 letters or within them: in the
one case both words reach the same state of A by those letters, in the other
they have the same letters left.  Each word therefore stands in a partition
for its first half and in one for its second half (as the shorter and as the
longer word), and a partition's words without the shared half are accepted
from an initial state of their own.  A partition with many letters is divided
the same way again, down to single letters, so no task holds an unbounded one.

In a task the partitions come in batches of bounded size.  One minimised
acceptor holds a whole batch; its states carry the number of words they
accept, so a path also counts out its word's place, and equal states at both
ends of an edit yield all their words at once.  Paths advance together in
numpy arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, text_slices, utf8

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: counts a task holds before it hands them on
HELD_WORDS = 200_000
#: letters of a partition from which it is divided, and of a batch of them
SPLIT_LETTERS = 1 << 18
BATCH_LETTERS = 1 << 19
#: composed states that are spread out at once
FRONT = 1 << 19


# -- words ---------------------------------------------------------------

def worn_word(run: str, before: int, noise: int) -> str:
    """``run`` (lower case), a letter short where ``noise`` divides the crc32
    of the text that ``before`` is the crc32 of, followed by the run."""
    h = zlib.crc32(run.encode(), before)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(noise: int | None, min_chars: int):
    def flush(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts.keys()), pa.string()),
                                           "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for b in text_slices(batches, "__text"):
            for i, t in zip(b.column("__id").to_pylist(), utf8(b.column("__text"))):
                if not t:
                    continue
                own = Counter(RUN.findall(t.translate(LOWER).decode("utf-8", "replace")))
                before = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in own.items():
                    if len(w) < min_chars:
                        continue
                    if noise:
                        w = worn_word(w, before, noise)
                        if len(w) < min_chars:
                            continue
                    counts[w] = counts.get(w, 0) + n
                if len(counts) >= HELD_WORDS:
                    yield flush(counts)
                    counts = {}
        if counts:
            yield flush(counts)
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = 97,
                min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts, A-Z in lower case, at
    least ``min_chars`` long and found ``min_count`` times or more.

    ``noise`` plants misspellings: where it divides h = crc32 of
    ``<id>:<run>``, the run loses its letter h % length; None plants none.
    Counts are summed in the tasks before they shuffle, so a word that is
    everywhere is a row for each task.  Null and empty texts have no words; a
    null id is the empty text in h; repeated rows count each; other columns
    are ignored; an empty table has no words.
    """
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    return (rows.mapInArrow(_count(noise, min_chars), schema)
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# -- partitions ----------------------------------------------------------

def _part(size, pre, rest, post, longer: bool, drop: bool):
    return F.struct(size.alias("size"), pre.alias("pre"), rest.alias("rest"), post.alias("post"),
                    F.lit(longer).alias("longer"), F.lit(drop).alias("drop"))


def _keyed(words: DataFrame, min_chars: int) -> DataFrame:
    """Each word in its partitions, as the shorter and as the longer word."""
    w, size, none = F.col("word"), F.length("word"), F.lit("")
    half, before = (F.floor(size / 2)).cast("int"), F.floor((size - 1) / 2).cast("int")
    as_short = [_part(size, F.left(w, half), F.substr(w, half + 1), none, False, False),
                _part(size, none, F.left(w, half), F.substr(w, half + 1), False, True)]
    as_long = [_part(size - 1, F.left(w, before), F.substr(w, before + 1), none, True, False),
               _part(size - 1, none, F.left(w, before + 1), F.substr(w, before + 2), True, True)]
    parts = F.when(size > min_chars, F.array(*as_short, *as_long)).otherwise(F.array(*as_short))
    return _hashed(words.select("word", "n", F.explode(parts).alias("p")).select("word", "n", "p.*"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("size", "pre", "post"))


def _divide(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` with every partition of over ``limit`` letters divided by
    halves of what its words don't share, until none is left that could be."""
    own = F.length("rest") - F.col("longer").cast("int")  # letters of the shorter word
    while True:
        hot = (rows.groupBy("key").agg(F.sum(F.length("rest")).alias("letters"), F.count(F.lit(1)).alias("words"),
                                       F.max(own).alias("own"))
               .filter(f"letters > {limit} AND words > 1 AND own > 1").select("key", F.lit(True).alias("hot")))
        if hot.isEmpty():
            return rows
        marked = rows.join(hot, "key", "left")
        r, half, tail = F.col("rest"), F.floor(own / 2).cast("int"), F.floor(own / 2).cast("int") + F.col("longer").cast("int")
        parts = F.array(
            F.struct(F.concat("pre", F.left(r, half)).alias("pre"), F.substr(r, half + 1).alias("rest"),
                     F.col("post"), F.col("drop")),
            F.struct(F.col("pre"), F.left(r, tail).alias("rest"),
                     F.concat(F.substr(r, tail + 1), F.col("post")).alias("post"), F.lit(True).alias("drop")))
        cut = (marked.filter("hot").select("word", "n", "size", "longer", F.explode(parts).alias("p"))
               .select("word", "n", "size", "p.pre", "p.rest", "p.post", "longer", "p.drop"))
        rows = marked.filter("hot IS NULL").drop("hot").unionByName(_hashed(cut))


# -- machines ------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Acceptor:
    """The minimised acceptor of sorted words, with an initial state for each
    machine (a run of rows with one number in ``machine`` and words of one
    length).  State 0 accepts; a path from a machine's ``start`` adds up the
    place of its word behind the machine's ``first`` row."""

    def __init__(self, machine: np.ndarray, codes: np.ndarray, length: np.ndarray):
        n, width = codes.shape
        cut = np.ones(n, dtype=bool)
        cut[1:] = machine[1:] != machine[:-1]
        # d: the place of the first letter that differs from the row before
        d = np.full(n, -1, dtype=np.int64)
        if n > 1:
            differs = codes[1:] != codes[:-1]
            d[1:] = np.where(cut[1:], -1, differs.argmax(axis=1))
        self.first = np.flatnonzero(cut)
        rows = np.arange(n)
        state = np.zeros(n, dtype=np.int64)      # of the row's path at this height
        child = np.ones(n, dtype=bool)           # does a path part here from the row before
        tail = np.zeros(n, dtype=np.uint64)
        source, symbol, target, self.words, masks = [], [], [], [np.array([1])], [np.array([1], dtype=np.uint64)]
        known = 1
        start = np.zeros(len(self.first), dtype=np.int64)
        alive = rows
        for height in range(1, width + 1):
            alive = alive[length[alive] >= height]
            if not len(alive):
                break
            at = length[alive] - height
            sym = codes[alive, at].astype(np.int64)
            tail[alive] = _mix(tail[alive] * np.uint64(0x9E3779B97F4A7C15) + sym.astype(np.uint64) + np.uint64(1))
            node = d[alive] < at                 # this row opens a path of this height
            node[d[alive] == -1] = True
            to_child = np.flatnonzero(child[alive])
            opens = np.flatnonzero(node)
            owner = np.cumsum(node) - 1          # path of each row
            edge_owner, edge_symbol, edge_target = owner[to_child], sym[to_child], state[alive[to_child]]
            mixed = (edge_symbol.astype(np.uint64) << np.uint64(40)) + edge_target.astype(np.uint64)
            begin = np.searchsorted(edge_owner, np.arange(len(opens)))
            sig = [np.add.reduceat(_mix(mixed + np.uint64(salt)), begin) for salt in (0x51ED27, 0xA0761D64)]
            order = np.lexsort(sig)
            new = np.ones(len(order), dtype=bool)
            new[1:] = (sig[0][order][1:] != sig[0][order][:-1]) | (sig[1][order][1:] != sig[1][order][:-1])
            cls = np.empty(len(order), dtype=np.int64)
            cls[order] = np.cumsum(new) - 1
            kept = order[new]                    # a path for each state
            count = np.add.reduceat(self._counts(known)[edge_target], begin)[kept]
            bits = np.bitwise_or.reduceat(np.uint64(1) << (tail[alive] >> np.uint64(58)), opens)[kept]
            sizes = np.diff(np.append(begin, len(edge_owner)))[kept]
            take = np.repeat(begin[kept] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            source.append(np.repeat(known + np.arange(len(kept)), sizes))
            symbol.append(edge_symbol[take])
            target.append(edge_target[take])
            self.words.append(count)
            masks.append(bits)
            state[alive] = known + cls[owner]
            child[alive] = node
            known += len(kept)
            done = length[alive[opens]] == height
            ended = alive[opens[done]]           # a machine's root, one for each
            start[np.searchsorted(self.first, ended, side="right") - 1] = state[ended]
        self.start = start
        self.words = np.concatenate(self.words)
        self.mask = np.concatenate(masks)
        source = np.concatenate(source) if source else np.zeros(0, np.int64)
        self.symbol = np.concatenate(symbol) if symbol else np.zeros(0, np.int64)
        self.target = np.concatenate(target) if target else np.zeros(0, np.int64)
        self.begin = np.searchsorted(source, np.arange(known + 1))
        self.alphabet = int(codes.max(initial=0)) + 1
        self.keys = source * self.alphabet + self.symbol
        # words that a state accepts before those of a transition
        total = np.concatenate([[0], np.cumsum(self.words[self.target])])
        self.skip = total[:-1] - total[self.begin[source]]

    def _counts(self, known: int) -> np.ndarray:
        if len(self.words) > 1:
            self.words = [np.concatenate(self.words)]
        return self.words[0]

    def out(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into q, transition) of all transitions from the states q."""
        deg = self.begin[q + 1] - self.begin[q]
        who = np.repeat(np.arange(len(q)), deg)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(deg) - deg, deg) + np.repeat(self.begin[q], deg)

    def match(self, q1: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, transition of q1, transition of q2) that read one letter."""
        who, t1 = self.out(q1)
        want = q2[who] * self.alphabet + self.symbol[t1]
        t2 = np.searchsorted(self.keys, want)
        ok = t2 < len(self.keys)
        ok[ok] = self.keys[t2[ok]] == want[ok]
        return who[ok], t1[ok], t2[ok]


class Composed:
    """Accepted pairs of rows of the acceptor, one edit and the acceptor."""

    def __init__(self, a: Acceptor):
        self.a, self.found = a, []

    def _edited(self, q1, r1, q2, r2) -> None:
        """From states behind the edit: both sides read the same letters."""
        a = self.a
        todo = [(q1, r1, q2, r2)]
        while todo:
            q1, r1, q2, r2 = todo.pop()
            if len(q1) > FRONT:
                h = len(q1) // 2
                todo += [(q1[:h], r1[:h], q2[:h], r2[:h]), (q1[h:], r1[h:], q2[h:], r2[h:])]
                continue
            live = (a.mask[q1] & a.mask[q2]) != 0
            same = live & (q1 == q2)
            if same.any():                       # equal states accept equal words
                n = a.words[q1[same]]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self.found.append((np.repeat(r1[same], n) + step, np.repeat(r2[same], n) + step))
            live &= q1 != q2
            if live.any():
                q1, r1, q2, r2 = q1[live], r1[live], q2[live], r2[live]
                who, t1, t2 = a.match(q1, q2)
                if len(who):
                    todo.append((a.target[t1], r1[who] + a.skip[t1], a.target[t2], r2[who] + a.skip[t2]))

    def replace(self, q: np.ndarray, r: np.ndarray) -> None:
        """Pairs of one machine's words with one letter replaced."""
        a = self.a
        todo = [(q, r)]
        while todo:
            q, r = todo.pop()
            keep = a.words[q] > 1                # a lone word has no partner
            q, r = q[keep], r[keep]
            deg = (a.begin[q + 1] - a.begin[q]).astype(np.int64)
            if len(q) > 1 and (deg * deg).sum() > FRONT:
                h = len(q) // 2
                todo += [(q[:h], r[:h]), (q[h:], r[h:])]
                continue
            if not len(q):
                continue
            who, t = a.out(q)
            todo.append((a.target[t], r[who] + a.skip[t]))
            later = np.repeat(np.cumsum(deg), deg) - np.arange(len(who)) - 1
            i = np.repeat(np.arange(len(who)), later)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
            live = (a.mask[a.target[t[i]]] & a.mask[a.target[t[j]]]) != 0
            i, j = i[live], j[live]
            self._edited(a.target[t[i]], r[who[i]] + a.skip[t[i]], a.target[t[j]], r[who[j]] + a.skip[t[j]])

    def insert(self, q1: np.ndarray, r1: np.ndarray, q2: np.ndarray, r2: np.ndarray) -> None:
        """Pairs of a word and one with a letter more, of two machines."""
        a = self.a
        todo = [(q1, r1, q2, r2)]
        while todo:
            q1, r1, q2, r2 = todo.pop()
            if len(q1) > 1 and (a.begin[q2 + 1] - a.begin[q2]).sum() > FRONT:
                h = len(q1) // 2
                todo += [(q1[:h], r1[:h], q2[:h], r2[:h]), (q1[h:], r1[h:], q2[h:], r2[h:])]
                continue
            if not len(q1):
                continue
            who, t = a.out(q2)
            self._edited(q1[who], r1[who], a.target[t], r2[who] + a.skip[t])
            who, t1, t2 = a.match(q1, q2)
            todo.append((a.target[t1], r1[who] + a.skip[t1], a.target[t2], r2[who] + a.skip[t2]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.found))


def near_pairs(group: np.ndarray, longer: np.ndarray, drop: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b), each pair once, of one batch in the order (group,
    longer, rest): shorter words with one letter replaced, and shorter words
    with the longer ones that have a letter more.  In a group of ``drop`` a
    letter more at the very end is found by another partition."""
    length = np.fromiter(map(len, rests), dtype=np.int64, count=len(rests))
    points = np.frombuffer("".join(rests).encode("utf-32-le"), dtype=np.uint32)
    symbols, code = np.unique(points, return_inverse=True)
    codes = np.zeros((len(rests), int(length.max(initial=0))), dtype=np.int32)
    row = np.repeat(np.arange(len(rests)), length)
    codes[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = code.reshape(-1) + 1
    machine = group * 2 + longer
    a = Acceptor(machine, codes, length)
    m = machine[a.first]
    short = np.flatnonzero(m % 2 == 0)
    replaced = Composed(a)
    replaced.replace(a.start[short], a.first[short])
    both = short[np.isin(m[short] + 1, m)]
    other = np.searchsorted(m, m[both] + 1)
    inserted = Composed(a)
    inserted.insert(a.start[both], a.first[both], a.start[other], a.first[other])
    x, y = inserted.pairs()
    if len(x):
        once = np.unique(x * len(rests) + y)     # one pair, several alignments
        x, y = once // len(rests), once % len(rests)
        check = np.flatnonzero(drop[x])
        width = codes.shape[1]
        inside = np.arange(width) < length[x[check], None]
        at_end = ((codes[x[check]] == codes[y[check]]) | ~inside).all(axis=1)
        keep = np.ones(len(x), dtype=bool)
        keep[check[at_end]] = False
        x, y = x[keep], y[keep]
    p, q = replaced.pairs()
    return np.concatenate([p, x]), np.concatenate([q, y])


def _batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Whole partitions, about ``limit`` letters (of the widest row) at a time."""
    held: list[pa.Table] = []
    rows = widest = 0
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        names = list(zip(*(t.column(c).to_pylist() for c in ("size", "pre", "post"))))
        lengths = [len(r) for r in t.column("rest").to_pylist()]
        start = 0
        for i, (k, n) in enumerate(zip(names, lengths)):
            if k != last and rows and (rows + 1) * max(widest, n) > limit:
                if i > start:
                    held.append(t.slice(start, i - start))
                yield pa.concat_tables(held)
                held, start, rows, widest = [], i, 0, 0
            last, rows, widest = k, rows + 1, max(widest, n)
        held.append(t.slice(start))
    if held:
        yield pa.concat_tables(held)


def _near(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(batches, limit):
            key = list(zip(*(t.column(c).to_pylist() for c in ("size", "pre", "post"))))
            group = np.cumsum([i > 0 and k != key[i - 1] for i, k in enumerate(key)])
            n = t.column("n").to_numpy()
            a, b = near_pairs(group, t.column("longer").to_numpy().astype(np.int64),
                              t.column("drop").to_numpy(), t.column("rest").to_pylist())
            if not len(a):
                continue
            words = t.column("word").to_pylist()
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            used, back = np.unique(b, return_inverse=True)
            by_text = sorted(range(len(used)), key=lambda k: words[used[k]])
            place = np.empty(len(used), dtype=np.int64)
            place[by_text] = np.arange(len(used))
            order = np.lexsort((place[back.reshape(-1)], -n[b], a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([words[i] for i in a[first]], pa.string()),
                "n_near": pa.array(np.diff(np.append(first, len(a))), pa.int64()),
                "near": pa.array([words[i] for i in b[first]], pa.string()),
                "near_n": pa.array(n[b[first]], pa.int64())})
    return run


# -- operator ------------------------------------------------------------

def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word that has a form, by pointer doubling: forms
    are at least twice as frequent as their words, so chains are short."""
    cur = scratch.put(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots-0")
    k = 0
    while not cur.filter("open").isEmpty():
        ahead = cur.select(F.col("word").alias("at"), F.col("root").alias("on"))
        step = (cur.filter("open").join(ahead, F.col("root") == F.col("at"), "left")
                .select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("open")))
        nxt = scratch.put(cur.filter("NOT open").unionByName(step), f"roots-{k + 1}")
        scratch.drop(f"roots-{k}")
        cur, k = nxt, k + 1
    return cur.select("word", "root")


def variants(words: DataFrame, min_chars: int = 5, ratio: int = 2, split_letters: int = SPLIT_LETTERS,
             batch_letters: int = BATCH_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row (word, n).

    Two words are near if one inserted, deleted or replaced code point turns
    one into the other; ``n_near`` counts a word's near words.  ``form`` is
    the near word of largest n (ties: the smallest in code-point order) if
    that n is at least ``ratio`` times the word's, else null, and ``form_n``
    its n; ``root`` is where the forms lead from the word (itself without a
    form).

    Words must be distinct, of ``min_chars`` (2 or more) code points or more;
    null words, shorter ones and null counts are left out.  An empty table
    gives no rows; other columns are ignored.  Near words are summed up in
    each partition, so pairs are never shuffled.  Tables are written in the
    shared folder and the result reads them.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.put(words.filter(F.col("word").isNotNull() & F.col("n").isNotNull()
                                     & (F.length("word") >= min_chars))
                        .select("word", F.col("n").cast("long").alias("n")), "words")
    rows = _divide(_keyed(words, min_chars), split_letters)
    out = StructType([StructField("word", StringType()), StructField("n_near", LongType()),
                      StructField("near", StringType()), StructField("near_n", LongType())])
    order = ["key", "size", "pre", "post", "longer", "rest"]
    parts = (rows.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
             .sortWithinPartitions(*order).mapInArrow(_near(batch_letters), out))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    has = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    judged = scratch.put(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "judged")
    scratch.drop("words")
    roots = _roots(judged.filter("form IS NOT NULL"), scratch)
    return (judged.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
