"""License scan by ordered signature rules.

A text's words are looked up among the rules' keywords first; only rules with
a keyword in the text run their regular expression over its words.  Of the
detections, one that lies inside a detection of a rule of higher priority (or
inside a longer one of its own rule) is suppressed: ``cc by`` in ``cc by sa``,
``apache license`` in ``apache license version 2``.  Detections of base
phrases have the highest priority and always stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from .common import arrow_schema, text_slices, utf8, with_text
from .license_rules import Rule, rules

#: words are runs of digits, letters and bytes beyond ASCII; the rest is a space
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

DETECTION = StructType([StructField("label", StringType()), StructField("priority", IntegerType()),
                        StructField("first_word", LongType()), StructField("last_word", LongType()),
                        StructField("strength", DoubleType()), StructField("base", BooleanType())])


class Scanner:
    """The rules, and from each keyword to its rules."""

    def __init__(self, found: list[Rule] | None = None):
        self.rules = rules() if found is None else found
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for k, r in enumerate(self.rules):
            for w in r.keywords:
                self.by_word[w.encode()].append(k)
        self.keywords = frozenset(self.by_word)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(rule, first word, last word) of every match of a gated rule."""
        gate = self.keywords.intersection(words)
        if not gate:
            return []
        line = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        spans = []
        for k in sorted({k for w in gate for k in self.by_word[w]}):
            for m in self.rules[k].pattern.finditer(line):
                first, end = np.searchsorted(spaces, (m.start(), m.end()))
                spans.append((k, int(first) - 1, int(end) - 1))
        return spans

    def detect(self, words: list[bytes]) -> list[tuple[Rule, int, int]]:
        """The matches that are left after suppression, in text order."""
        spans = self.matches(words)
        kept: list[tuple[int, int, int]] = []
        by_rule: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, a, b in spans:
            by_rule[k].append((a, b))
        starts = np.zeros(0, dtype=np.int64)
        reach = np.zeros(0, dtype=np.int64)   # the furthest end among starts up to here
        for k in sorted(by_rule, key=lambda k: self.rules[k].priority):
            own = np.array(by_rule[k], dtype=np.int64)
            inside = np.zeros(len(own), dtype=bool)
            if len(starts) and not self.rules[k].base:
                at = np.searchsorted(starts, own[:, 0], side="right") - 1
                inside = (at >= 0) & (reach[np.maximum(at, 0)] >= own[:, 1])
            own = own[~inside]
            kept += [(k, int(a), int(b)) for a, b in own]
            if len(own):
                ends = np.concatenate([reach, own[:, 1]])
                starts = np.concatenate([starts, own[:, 0]])
                order = np.argsort(starts, kind="stable")
                starts, reach = starts[order], np.maximum.accumulate(ends[order])
        return [(self.rules[k], a, b) for k, a, b in sorted(kept, key=lambda x: (x[1], x[0], x[2]))]


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def _scan(schema: StructType, place: int):
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in text_slices(batches, place):
            n, lists, scores = [], [], []
            for text in utf8(b.column(place)):
                words = split_words(text)
                found = scanner.detect(words)
                n.append(len(words))
                doubt = 1.0
                for strength in {(r.label, r.strength): r.strength for r, _, _ in found}.values():
                    doubt *= 1.0 - strength
                scores.append(1.0 - doubt)
                lists.append([{"label": r.label, "priority": r.priority, "first_word": a, "last_word": e,
                               "strength": r.strength, "base": r.base} for r, a, e in found])
            cols = {"n_words": pa.array(n, pa.int64()), "detections": pa.array(lists, target.field("detections").type),
                    "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else b.column(f.name) for f in target],
                                             schema=target)
    return run


def scan_licenses(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """(carry..., n_words, detections, score), a row for each input row.

    ``detections`` lists what stays after suppression, in text order: label,
    rule priority (0 first), first and last word (from 0), strength and
    whether a base phrase made it.  ``score`` is the confidence that the text
    bears a license: 1 - the product of (1 - strength) over distinct labels
    and strengths, 0 without detections.

    The ``carry`` columns (default: doc_id) must not be called n_words,
    detections or score; others are ignored.  Null and empty texts have no
    words; repeated rows are scanned each; an empty table gives no rows.  A
    long text is scanned whole, in time that grows with its length: gaps in
    patterns are bounded.
    """
    carry = ["doc_id"] if carry is None else carry
    clash = {"n_words", "detections", "score"}.intersection(carry)
    if clash:
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")
    rows, place = with_text(docs, carry, text_col)
    schema = StructType([docs.schema[c] for c in carry] + [StructField("n_words", LongType()),
                                                           StructField("detections", ArrayType(DETECTION)),
                                                           StructField("score", DoubleType())])
    return rows.mapInArrow(_scan(schema, place), schema)
