"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into classes: insult,
threat, target, negation, reported speech, function word, pause or other;
elided articles and contractions are taken apart, threats are inflected by
rule.  Small machines watch the classes: a negation holds for the next few
words up to a pause, where function words don't count; reported speech and a
target hold for the rest of the clause, a threat waits for its target.  Their
composition reads the clause once and writes its matches: an insult that is
plain, aimed at a target, negated or reported, and a threat likewise.  A last
machine reads from the clause's end: speech attributed after a pause (", he
said") is reported too.  The
grammar is fixed; its weights are learned from a bounded labelled sample:
insult stems with their log-odds, the log-odds of every kind of match, and
the line that turns a document's matched clauses into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import Scratch, arrow_schema, text_slices
from .labelled import labelled_sample

#: rows of the labelled sample; documents and precision that a stem needs;
#: stem lengths; words that a negation reaches; strength of the prior odds.
SAMPLE_ROWS, STEM_DOCS, STEM_PRECISION = 12_000, 6, 0.8
STEM_MIN, STEM_MAX, REACH, PRIOR_DOCS = 3, 8, 3, 5.0

#: bands of min-hashes, min-hashes in a band, similarity of near copies.
BANDS, BAND, ALIKE = 8, 4, 0.8

# Closed word classes of the four languages.
TARGETS = ("you your yours he him she her they them these this those people du dich dir ihr euch sie er diese dieser "
           "tu te toi vous il elle ils elles ce cette ces tú usted ustedes él ella ellos ellas este esta esos").split()
NEGATIONS = ("not no never isn't aren't wasn't don't neither nor without nicht kein keine keinen nie niemals ne pas "
             "jamais aucun ni nunca jamás ningún ninguna").split()
REPORTS = ("said says say told wrote writes quoted quote according claimed reported reportedly called sagte sagt "
           "claims claiming saying tells telling writing schrieb laut zitierte dit disait écrit selon cité dijo dice escribió según citó").split()
FUNCTION_WORDS = ("a an the of to be being is are am was were been like as so such very any that it der das ein eine "
                  "einen einem einer ist bist sind war wie sehr un une le la les est sont était comme si très el los "
                  "las una unos unas es eres son era como tan muy").split()
THREAT_VERBS = {
    "en": "kill hurt destroy shoot stab beat burn murder strangle choke punch smash slaughter".split(),
    "de": "töten umbringen verletzen zerstören erschießen erwürgen verprügeln ermorden".split(),
    "fr": "tuer frapper brûler étrangler poignarder".split(),
    "es": "matar golpear quemar estrangular apuñalar".split()}
THREATS_IRREGULAR = "détruire détruis détruit détruirai détruira destruir destruyo destruye destruiré destruirá".split()
ENDINGS = {"de": ("en", "en e st est t et".split()),
           "fr": ("er", "er e es ons ez ent erai eras era erons erez eront".split()),
           "es": ("ar", "ar o as a amos an aré arás ará aremos arán".split())}


def inflect(verb: str, lang: str) -> list[str]:
    """The forms of a regular verb that can threaten: infinitive, present and
    future (the past tells what happened)."""
    if lang == "en":
        doubled = len(verb) > 2 and verb[-1] in "bgnpt" and verb[-2] in "aeiou" and verb[-3] not in "aeiou"
        stem = verb[:-1] if verb.endswith("e") else verb + verb[-1] if doubled else verb
        return [verb, verb + ("es" if verb.endswith(("sh", "ch", "s", "x")) else "s"), stem + "ing"]
    ending, forms = ENDINGS[lang]
    return [verb.removesuffix(ending) + f for f in forms]


THREATS = sorted({f for lang, verbs in THREAT_VERBS.items() for v in verbs for f in inflect(v, lang)}
                 | set(THREATS_IRREGULAR))

CLASSES = 8
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, FUNCTION, PAUSE = range(CLASSES)
KINDS = ["plain", "aimed", "negated", "reported", "threat", "threat negated", "threat reported"]
REPORTED = {"plain": "reported", "aimed": "reported", "threat": "threat reported"}
PRIOR = {"plain": 0.9, "aimed": 0.95, "negated": 0.3, "reported": 0.3,
         "threat": 0.8, "threat negated": 0.2, "threat reported": 0.2}

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(_WORD.pattern + r'|[,"“”«»—–]')
_CLAUSE = re.compile(r"[.!?;:\n]+")
_ELIDED = re.compile(r"\b(?:[cdjlmst]|qu)'(?=[^\W\d_]{2})")
_CLOSED = ({w: FUNCTION for w in FUNCTION_WORDS} | {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS}
           | {w: REPORT for w in REPORTS} | {w: THREAT for w in THREATS})


def _low(text: str) -> str:
    """Lower case, one kind of apostrophe, French elisions taken apart."""
    low = text.lower()
    if "\u2019" in low:
        low = low.replace("\u2019", "'")
    return _ELIDED.sub("", low).replace(" n'", " ne ") if "'" in low else low


def word_class(token: str) -> int:
    """The closed class of a word or a mark; a contraction has its first
    word's (you're), or is a negation (doesn't)."""
    c = _CLOSED.get(token)
    if c is not None:
        return c
    if not token[0].isalpha():
        return PAUSE
    if "'" in token:
        return NEGATION if token.endswith("n't") else _CLOSED.get(token.partition("'")[0], OTHER)
    return OTHER


# --- the machines: state, word class -> state -------------------------------

def _negation(state: int, c: int) -> int:
    if c in (NEGATION, PAUSE):
        return REACH if c == NEGATION else 0
    return state if c == FUNCTION else max(0, state - 1)


def _report(state: int, c: int) -> int:
    return int(state or c == REPORT)


def _target(state: int, c: int) -> int:
    return int(state or c == TARGET)


def _threat(state: int, c: int) -> int:
    """1: a threat waits for a target, 2: it has found one."""
    if c == THREAT:
        return 1
    return 2 if state == 1 and c == TARGET else state % 2


def _attributed(state: int, c: int) -> int:
    """Reads from the end: a report and up to two words more, then a pause;
    all before it is reported (``HOLDS``)."""
    if state == HOLDS or c == PAUSE:
        return HOLDS if state else 0
    if c == REPORT:
        return HOLDS - 1
    return state if c == FUNCTION else max(0, state - 1)


HOLDS = 4
MACHINES = (_negation, _report, _target, _threat)


def _match(before: tuple[int, ...], after: tuple[int, ...], c: int) -> str | None:
    """What the composition writes on a step."""
    negated, reported, aimed, _ = before
    if c == INSULT:
        return "negated" if negated else "reported" if reported else "aimed" if aimed else "plain"
    if after[3] == 2 or (c == THREAT and aimed):
        return "threat negated" if negated else "threat reported" if reported else "threat"
    return None


def compose() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the product machine: next state and kind (-1: none)."""
    start = (0,) * len(MACHINES)
    number, todo, moves = {start: 0}, [start], {}
    while todo:
        s = todo.pop()
        for c in range(CLASSES):
            t = tuple(m(x, c) for m, x in zip(MACHINES, s))
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            kind = _match(s, t, c)
            moves[number[s], c] = number[t], KINDS.index(kind) if kind else -1
    step, out = (np.zeros((len(number), CLASSES), dtype=np.int64) for _ in range(2))
    for (s, c), (t, k) in moves.items():
        step[s, c], out[s, c] = t, k
    return step, out


_STEP, _OUT = (x.tolist() for x in compose())


class Grammar:
    """The composed grammar with learned weights."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems  # stem -> log-odds; a stem ending in "$" is a whole word
        self.heads = {s.rstrip("$")[:STEM_MIN] for s in stems} | {w[:STEM_MIN] for w in THREATS}
        self.kinds = {k: _logit(p) for k, p in PRIOR.items()}
        self.slope, self.shift, self.rest = 1.0, 0.0, 0.01

    def insult(self, word: str) -> float | None:
        best = self.stems.get(word + "$")
        for k in range(STEM_MIN, min(STEM_MAX, len(word)) + 1):
            w = self.stems.get(word[:k])
            if w is not None and (best is None or w > best):
                best = w
        return best

    def matches(self, text: str | None) -> list[tuple[int, str, float]]:
        """(clause number, kind, weight of the insult) of all matches."""
        if not text:
            return []
        low = _low(text)
        hits: dict[str, float | None] = {}
        for w in set(_WORD.findall(low)):
            if w[:STEM_MIN] in self.heads:
                weight = self.insult(w)
                if weight is not None or w in _CLOSED and _CLOSED[w] == THREAT:
                    hits[w] = weight
        if not hits:
            return []
        found = []
        for n, clause in enumerate(_CLAUSE.split(low)):
            words = _TOKEN.findall(clause)
            if not any(w in hits for w in words):
                continue
            classes = [INSULT if hits.get(w) is not None else word_class(w) for w in words]
            state, own = 0, []
            for i, (w, c) in enumerate(zip(words, classes)):
                if _OUT[state][c] >= 0:
                    weight = hits.get(w)
                    own.append((i, KINDS[_OUT[state][c]], weight if weight is not None else 2.0))
                state = _STEP[state][c]
            state, last = 0, len(words) - 1
            for at in range(len(own) - 1, -1, -1):
                i, kind, weight = own[at]
                while last > i:
                    state = _attributed(state, classes[last])
                    last -= 1
                own[at] = i, REPORTED.get(kind, kind) if state == HOLDS else kind, weight
            found += [(n, kind, weight) for _, kind, weight in own]
        return found

    def strength(self, found: list[tuple[int, str, float]]) -> float:
        """Of the strongest clause, and a little for every other one."""
        clauses: dict[int, float] = {}
        for n, kind, weight in found:
            clauses[n] = max(clauses.get(n, -9.0), (weight + self.kinds[kind]) / 2)
        return max(clauses.values()) + 0.3 * math.log(len(clauses))

    def score(self, text: str | None) -> float:
        found = self.matches(text)
        if not found:
            return self.rest
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.slope * self.strength(found) + self.shift))))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash of the text without case and spacing, the hashes of its
    distinct words and its bands of min-hashes."""
    rng = np.random.default_rng(9)
    turn, shift = (rng.integers(1, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    for b in text_slices(batches, "__text"):
        keys, words, bands = [], [], []
        for t in b.column("__text").to_pylist():
            low = _low(t)
            keys.append(xxhash.xxh3_128_hexdigest(" ".join(low.split())))
            h = np.array(sorted({xxhash.xxh3_64_intdigest(w) for w in _WORD.findall(low)}), dtype=np.uint64)
            words.append(h.view(np.int64))
            low_words = [(h * a + c).min() for a, c in zip(turn, shift)] if len(h) else []
            bands.append([f"{k}:{xxhash.xxh3_64_intdigest(np.array(low_words[k * BAND:(k + 1) * BAND]).tobytes())}"
                          for k in range(BANDS)] if len(h) else [])
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(keys), pa.array(words, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.string()))],
            names=[*b.schema.names, "__key", "__words", "__bands"])


def without_copies(sample: DataFrame, scratch: Scratch) -> DataFrame:
    """The sample without copies.  Of texts that differ in case and spacing
    alone the row with the smallest id stays.  Of rows that share a band of
    min-hashes, those go whose word set has a Jaccard similarity of ``ALIKE``
    or more with that of the row with the smallest id; it is compared exactly."""
    schema = (StructType(list(sample.schema)).add("__key", "string").add("__words", ArrayType(LongType()))
              .add("__bands", ArrayType(StringType())))
    first = (sample.mapInArrow(_signature, schema)
             .groupBy("__key").agg(F.min(F.struct("__id", "__y", "__text", "__words", "__bands")).alias("r"))
             .select("__key", "r.*"))
    rows = scratch.put(first, "signed")
    bands = rows.select("__id", "__key", F.explode("__bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min(F.struct("__id", "__key")).alias("h")).select("band", F.col("h.__key").alias("head"))
    pairs = bands.join(heads, "band").filter("__key != head").select("__key", "head").distinct()
    both = (pairs.join(rows.select("__key", F.col("__words").alias("a")), "__key")
            .join(rows.select(F.col("__key").alias("head"), F.col("__words").alias("b")), "head"))
    same = F.size(F.array_intersect("a", "b"))
    copies = both.filter(same >= ALIKE * (F.size("a") + F.size("b") - same)).select("__key").distinct()
    kept = scratch.put(rows.join(copies, "__key", "left_anti").select("__id", "__text", "__y"), "sample")
    scratch.drop("signed")
    return kept


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every: Counter = Counter()
    toxic: Counter = Counter()
    for b in batches:
        for t, y in zip(b.column("__text").to_pylist(), b.column("__y").to_pylist()):
            words = set(_WORD.findall(_low(t)))
            stems = {w[:k] for w in words for k in range(STEM_MIN, min(STEM_MAX, len(w)) + 1)}
            stems |= {w + "$" for w in words}
            every.update(stems)
            if y:
                toxic.update(stems)
    if every:
        stems = list(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(stems), pa.array([every[s] for s in stems], pa.int64()),
             pa.array([toxic[s] for s in stems], pa.int64())], names=["stem", "n", "toxic"])


def choose_stems(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of the insult stems among (documents, toxic documents).  The
    shortest stem that is precise enough wins, drawn out as long as it keeps
    nearly all its documents; whole words come last."""
    out: dict[str, float] = {}
    good = {s for s, (n, t) in counts.items() if t >= STEM_DOCS and t >= STEM_PRECISION * n}
    for s in sorted(good, key=lambda s: (s.endswith("$"), len(s), s)):
        bare = s.rstrip("$")
        if any(bare[:k] in out for k in range(1, len(bare) + 1)):
            continue
        if not s.endswith("$"):
            longer = True
            while longer:
                longer = next((x for x in sorted(good) if len(x) == len(s) + 1 and x.startswith(s) and x[-1] != "$"
                               and counts[x][0] >= 0.95 * counts[s][0]), None)
                s = longer or s
        n, t = counts[s]
        out[s] = min(4.0, _logit((t + 0.5) / (n + 1.0)))
    return out


def _observe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in text_slices(batches, "__text"):
            found = [g.matches(t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("__y"), pa.array([[{"clause": c, "kind": k, "weight": w} for c, k, w in f] for f in found],
                                           pa.list_(pa.struct([("clause", pa.int64()), ("kind", pa.string()),
                                                               ("weight", pa.float64())])))],
                names=["y", "found"])
    return run


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic line, drawn towards (1, 0)."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (p - y) + (w - [1.0, 0.0])
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2), grad)
    return float(max(w[0], 0.05)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", rows: int = SAMPLE_ROWS) -> Grammar:
    """The grammar with weights from ``rows`` labelled documents at most; of
    copies in the sample one counts (``without_copies``).  Without
    any it has no insult stems."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    sample = labelled_sample(docs, labels, label_col, rows, 9, id_col, text_col)
    kept = without_copies(sample, scratch)
    counted = (kept.mapInArrow(_stem_counts, "stem string, n long, toxic long")
               .groupBy("stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
               .filter((F.col("toxic") >= STEM_DOCS) & (F.col("toxic") >= STEM_PRECISION * F.col("n"))).collect())
    g = Grammar(choose_stems({r["stem"]: (r["n"], r["toxic"]) for r in counted}))
    seen = kept.mapInArrow(_observe(spark.sparkContext.broadcast(g)),
                           "y int, found array<struct<clause:long,kind:string,weight:double>>").collect()
    scratch.drop("sample")
    total, bad = Counter(), Counter()
    for r in seen:
        for kind in {m["kind"] for m in r["found"]}:
            total[kind] += 1
            bad[kind] += r["y"]
    for kind, p in PRIOR.items():
        g.kinds[kind] = _logit((bad[kind] + PRIOR_DOCS * p) / (total[kind] + PRIOR_DOCS))
    matched = [r for r in seen if r["found"]]
    if matched:
        x = np.array([g.strength([(m["clause"], m["kind"], m["weight"]) for m in r["found"]]) for r in matched])
        g.slope, g.shift = _fit_line(x, np.array([r["y"] for r in matched], dtype=float))
    rest = [r["y"] for r in seen if not r["found"]]
    g.rest = (sum(rest) + 0.05) / (len(rest) + 1)
    return g


def _scores(shared, schema):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in text_slices(batches, "__text"):
            out = [g.score(t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(out, pa.float64())], schema=target)
    return run


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), a row for each input row: the probability of label 1.

    Null, empty and blank texts have no clause that matches and get the share
    of toxic texts among such.  Whole texts are read, however long.  Repeated
    rows get a row each, with one score.  Other columns are ignored.  Empty
    table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    schema = StructType([StructField("__id", docs.schema[id_col].dataType), StructField("score", DoubleType())])
    return (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .mapInArrow(_scores(shared, schema), schema).withColumnRenamed("__id", id_col))
