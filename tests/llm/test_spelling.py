"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm.queries import ORACLE, QUERIES
from tallyspark.llm.spelling import near_pairs, variants, word_counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if v != w and one_edit(v, w)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def plain_counts(docs, min_count=3):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= min_count and len(w) >= 5}


def random_words(seed, n=600, letters="abé"):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))): rng.randint(3, 60) for _ in range(n)}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("split, batch", [(1 << 18, 1 << 19), (300, 200), (20, 1)])
def test_equals_all_pairs_at_any_division(spark, split, batch):
    counts = random_words(split)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = variants(df, split_letters=split, batch_letters=batch).collect()
    assert len(rows) == len(counts)
    assert found(variants(df, split_letters=split, batch_letters=batch)) == plain_variants(counts)


def test_machine_pairs_of_one_batch():
    rng = random.Random(5)
    rows = []
    for g in range(30):
        words = {"".join(rng.choice("xyz") for _ in range(rng.choice([4, 5]))) for _ in range(25)}
        rows += sorted((g, len(w) == 5, w) for w in words)
    a, b = near_pairs(np.array([r[0] for r in rows]), np.array([int(r[1]) for r in rows]),
                      np.zeros(len(rows), dtype=bool), [r[2] for r in rows])
    got = sorted(zip(a.tolist(), b.tolist()))
    want = [(i, j) for i, r in enumerate(rows) for j, s in enumerate(rows)
            if r[0] == s[0] and one_edit(r[2], s[2]) and (not r[1] and (s[1] or i < j))]
    assert got == want


def test_query_equals_plain_python(spark, sf):
    import duckdb
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    counts = plain_counts(docs)
    got = found(QUERIES["op13_spelling"](spark, sf))
    assert {w: v[2] for w, v in got.items()} == counts
    assert "op13_spelling" in ORACLE  # the rest of the row is held against SQL


def test_query_equals_sql(spark, sf, duck):
    from harness import compare
    r = compare(spark, duck, "op13", QUERIES["op13_spelling"], ORACLE["op13_spelling"], sf)
    assert "error" not in r, r


def test_odd_rows(spark, rows):
    text = "Straße straße! STRASSE strasse strasse strasse Straßen strasze strasze strasze"
    data = [(1, text, "x"), (1, text, "y"), (None, text, None), (4, None, None), (5, "", None), (6, "a b 12 —", "z"),
            (7, "Ünlich " * 5000 + "x" * 100_000, None)]
    docs = rows(data, "doc_id long, text string, word string")
    counts = {r["word"]: r["n"] for r in word_counts(docs).collect()}
    assert counts == plain_counts([(r[0], r[1]) for r in data])
    clash = word_counts(docs).selectExpr("*", "n AS size", "word AS key", "word AS root")
    assert found(variants(clash)) == plain_variants(counts)
    plain = {r["word"]: r["n"] for r in word_counts(docs, noise=None, min_count=1).collect()}
    assert plain["x" * 100_000] == 1 and plain["strasse"] == 3 * 4


def test_empty_and_null_words(spark, rows):
    assert word_counts(rows([])).count() == 0
    none = variants(spark.createDataFrame([], "word string, n long"))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.count() == 0
    df = spark.createDataFrame([(None, 3), ("abc", 9), ("words", None), ("sword", 3), ("swords", 6)], "word string, n int")
    assert found(variants(df)) == {"sword": ("swords", "swords", 3, 1, 6), "swords": (None, "swords", 6, 1, None)}


def test_long_words_in_a_crowded_partition(spark):
    """A third of the words share half their letters; chains of forms."""
    rng = random.Random(8)
    counts = {"international" + "".join(rng.choice("abcdefgh") for _ in range(4)) + "izations" * 3: rng.randint(3, 99)
              for _ in range(150)}
    counts |= random_words(3, 300, "abcd")
    counts |= {"chain" + "s" * k: 3 * 2 ** k for k in range(12)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(variants(df, split_letters=400, batch_letters=500))
    assert got == plain_variants(counts)
    assert got["chain"][1] == "chain" + "s" * 11
