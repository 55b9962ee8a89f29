"""Searching by trigrams gives what searching every note gives."""

import random
import tempfile

import pytest

from tallyspark.operators.filters import search_notes
from tallyspark.operators.note_index import NoteIndex, _grams_of, trigram_formula

PATTERNS = ["coffee", "COFFEE", "cof{2}ee", "coff?ee", "(tea|coffee) shop", "^Uber", "ride$", "u.er", "ub", "", "[cC]af[eé]",
            "tax[0-9]{2}", "(ab|cd)+ef", "x(?=yz)", "a|b", "déj", "\\bshop\\b", "paid\\.", "a{0,2}ride", "sh[a-z]p", "(?:no){2}te", "é+t", "[^a]bc",
            "(uber|ride|tea) ?(home|shop)?"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    words = ["coffee", "Coffee", "tea", "shop", "Uber", "ride", "café", "CAFE", "tax12", "tax7", "abcdef", "cdef", "xyz", "déjà", "paid.", "note", "nonote", "été"]
    data = [(i, None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(400)]
    data += [(1000 + i, "coffee shop") for i in range(200)]  # one note holds a third of the rows
    return spark.createDataFrame(data, "id long, notes string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_same_rows_for_all_patterns(spark, rows):
    index = NoteIndex.build(rows, tempfile.mkdtemp(prefix="notes-", dir="/tmp") + "/i")
    for p in PATTERNS:
        want = rows.filter("notes IS NOT NULL") if p == "" else search_notes(rows, p)
        assert ids(index.search(p)) == ids(want), p


def test_appended_rows_are_found_once(spark, rows):
    index = NoteIndex.build(rows.filter("id < 200"), tempfile.mkdtemp(prefix="notes-", dir="/tmp") + "/i")
    index.append(rows.filter("id >= 200"))
    for p in ("coffee", "Uber", "t"):
        assert ids(index.search(p)) == ids(search_notes(rows, p))


def test_candidates_are_fewer_than_the_notes(spark, rows):
    index = NoteIndex.build(rows, tempfile.mkdtemp(prefix="notes-", dir="/tmp") + "/i")
    every = index.candidates("e").count()
    assert 0 < index.candidates("déjà").count() < every / 2
    plan = index.search("coffee")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "")


@pytest.mark.parametrize("pattern, formula", [
    ("coffee", ("and", ["cof", "off", "ffe", "fee"])),
    ("(tea|rum) x", ("or", [("and", ["rum", "um ", "m x"]), ("and", ["tea", "ea ", "a x"])])),
    ("ab", True), ("a.c", True), ("abc.*def", ("and", ["abc", "def"])), ("abc|de", True), ("(abc)?", True), ("(abc)+", "abc"),
    ("\\Qabc\\E", True), ("ab[cd]e", ("or", [("and", ["abc", "bce"]), ("and", ["abd", "bde"])])), ("(?s)abc", True)])
def test_formula(pattern, formula):
    assert trigram_formula(pattern) == formula


def test_a_formula_never_excludes_a_match():
    import re
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        pattern = "".join(rng.choice(["a", "b", "c", "d", "ab", "(bc|a)", "c?", "d+", "[ab]", ".", "(cd)*", "a{2}"]) for _ in range(rng.randint(1, 6)))
        if re.search(pattern, text, re.I):
            grams = {text[i:i + 3] for i in range(len(text))}

            def holds(f):
                return f is True or (f in grams if isinstance(f, str) else (all if f[0] == "and" else any)(map(holds, f[1])))
            assert holds(trigram_formula(pattern)), (pattern, text, _grams_of(trigram_formula(pattern)))
