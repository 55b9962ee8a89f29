"""Note search by a trigram index (P2, P3 without a scan of all notes).

The index is three Parquet tables: the distinct notes with a number each, the
postings (trigram, note number), range-sorted so that a search reads the row
groups of its trigrams alone, and the expenses sorted by note number.  A
pattern is read as a formula over trigrams that every matching note must hold;
notes that satisfy the formula are candidates and are matched exactly.  A
pattern without such a formula falls back to matching every distinct note.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: strings that a part of a pattern may stand for before it is left open
MOST_STRINGS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)

#: a formula: True (any note), a trigram, ("and", formulas) or ("or", formulas)
Formula = bool | str | tuple


def _join(kind: str, parts: Iterable[Formula]) -> Formula:
    """``and`` without what is always true, ``or`` that is true if a part is."""
    flat: list[Formula] = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        for q in (p[1] if isinstance(p, tuple) and p[0] == kind else [p]):
            if q not in flat:
                flat.append(q)
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, flat)


def _of_string(s: str) -> Formula:
    return _join("and", [s[i:i + 3] for i in range(len(s) - 2)])


def _of_strings(strings: Iterable[str]) -> Formula:
    return _join("or", [_of_string(s) for s in sorted(strings)])


class _Reader:
    """The formula of a parsed pattern, and its strings where they are few."""

    def sequence(self, items) -> tuple[set[str] | None, Formula]:
        held, whole, formulas = {""}, True, []
        for item in items:
            strings, formula = self.item(*item)
            if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
                held = {a + b for a, b in product(held, strings)}
                continue
            # the run of known strings ends here
            whole = False
            formulas += [_of_strings(held), formula if strings is None else _of_strings(strings)]
            held = strings if strings is not None else {""}
        if whole:
            return held, _of_strings(held)
        return None, _join("and", [*formulas, _of_strings(held)])

    def item(self, op, arg) -> tuple[set[str] | None, Formula]:
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).translate(_FOLD)}, True
        if name == "AT":  # an anchor stands for nothing
            return {""}, True
        if name == "IN":
            chars = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(value).translate(_FOLD))
                elif str(kind) == "RANGE" and value[1] - value[0] < MOST_STRINGS:
                    chars |= {chr(c).translate(_FOLD) for c in range(value[0], value[1] + 1)}
                else:
                    return None, True
            return (chars if len(chars) <= MOST_STRINGS else None), True
        if name == "SUBPATTERN":
            return self.sequence(arg[3])
        if name == "BRANCH":
            parts = [self.sequence(p) for p in arg[1]]
            strings = [p[0] for p in parts]
            if all(s is not None for s in strings) and len(set().union(*strings)) <= MOST_STRINGS:
                return set().union(*strings), _of_strings(set().union(*strings))
            return None, _join("or", [p[1] for p in parts])
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, what = arg
            strings, formula = self.sequence(what)
            if strings is not None and low == high == 1:
                return strings, formula
            if strings is not None and (low, high) == (0, 1) and len(strings) < MOST_STRINGS:
                return strings | {""}, True
            if low == 0:
                return None, True
            return None, formula if strings is None else _of_strings(strings)
        if name == "ATOMIC_GROUP":
            return self.sequence(arg)
        return None, True  # look-around, back references, any character: no demand


def trigram_formula(pattern: str) -> Formula:
    """What a note must hold to match ``pattern`` with any case; True where
    nothing can be said (also for syntax that only Java reads)."""
    import re
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return True
    # flags or escapes that mean something else in Java: no demand
    if tree.state.flags & ~re.UNICODE.value & ~re.IGNORECASE.value or "\\Q" in pattern or "&&" in pattern or "\\" in pattern and _odd_escape(pattern):
        return True
    return _Reader().sequence(tree)[1]


def _odd_escape(pattern: str) -> bool:
    """Escapes read unlike in the two dialects."""
    return any(pattern[i] == "\\" and pattern[i + 1:i + 2].isalnum() and pattern[i + 1] not in "dDwWsSbBntrf"
               for i in range(len(pattern) - 1))


def _holds(formula: Formula, grams: str = "grams") -> Column:
    if formula is True:
        return F.lit(True)
    if isinstance(formula, str):
        return F.array_contains(grams, formula)
    out = None
    for p in formula[1]:
        c = _holds(p, grams)
        out = c if out is None else (out & c if formula[0] == "and" else out | c)
    return out


def _grams_of(formula: Formula) -> list[str]:
    if formula is True:
        return []
    return [formula] if isinstance(formula, str) else sorted({g for p in formula[1] for g in _grams_of(p)})


class NoteIndex:
    """An index at ``path`` (shared storage); ``build`` writes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, expenses: DataFrame, path: str) -> NoteIndex:
        """Index ``expenses`` (any columns, one of them ``notes``)."""
        index = cls(expenses.sparkSession, path)
        index._add(expenses, None)
        return index

    def append(self, expenses: DataFrame) -> None:
        """Add rows; only notes that are new get a number and postings.  Notes
        are written first and rows last, so a search during or after a
        writer's death sees whole rows or none of them."""
        self._add(expenses, self._read("notes"))

    def _add(self, expenses: DataFrame, known: DataFrame | None) -> None:
        notes = expenses.filter("notes IS NOT NULL").select("notes").distinct()
        if known is not None:
            notes = notes.join(known.select("notes"), "notes", "left_anti")
        # a number from the text itself: equal on a second run, no counter to keep
        numbered = notes.select("notes", F.xxhash64("notes").alias("note_id"), F.sha2(F.col("notes").cast("binary"), 256).alias("digest"))
        numbered.write.mode("append").parquet(f"{self.path}/notes")
        text = F.translate("notes", UPPER, LOWER)
        grams = F.array_distinct(F.transform(F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)), lambda i: F.substring(text, i, F.lit(3))))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # postings of every note of these rows: also of those that a writer which
        # died had numbered (a posting twice does no harm)
        written = self._read("notes") if known is None else self._read("notes").join(expenses.select("notes").distinct(), "notes", "left_semi")
        (written.select(F.explode(grams).alias("gram"), "note_id").distinct()
         .repartitionByRange(n, "gram", "note_id").sortWithinPartitions("gram", "note_id")
         .write.mode("append").parquet(f"{self.path}/postings"))
        (expenses.withColumn("note_id", F.xxhash64("notes")).repartitionByRange(n, "note_id", F.xxhash64(*expenses.columns))
         .sortWithinPartitions("note_id").write.mode("append").parquet(f"{self.path}/rows"))

    def candidates(self, pattern: str) -> DataFrame:
        """Distinct notes that may match, by postings of the pattern's
        trigrams; all of them if it demands none."""
        formula = trigram_formula(pattern)
        notes = self._read("notes")
        grams = _grams_of(formula)
        if not grams:
            return notes
        hits = (self._read("postings").filter(F.col("gram").isin(grams)).groupBy("note_id")
                .agg(F.collect_set("gram").alias("grams")).filter(_holds(formula)).select("note_id"))
        return notes.join(hits, "note_id", "left_semi")

    def search(self, pattern: str) -> DataFrame:
        """The rows that ``filters.search_notes`` gives, by the index."""
        found = self.candidates(pattern).filter(F.col("notes").rlike("(?i)" + pattern)).select("note_id", "notes").distinct()
        rows = self._read("rows")
        # two notes of one number are told apart by their text
        return rows.join(found, ["note_id", "notes"], "left_semi").drop("note_id")
