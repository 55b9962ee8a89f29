"""The license scan against slow, plain versions of its steps."""

import random
import re

import duckdb
import pytest

from tallyspark.llm.license_rules import BASE, rules
from tallyspark.llm.license_scan import Scanner, scan_licenses, split_words
from tallyspark.llm.queries import QUERIES


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_base(words):
    out = []
    for phrase, label in BASE:
        p = phrase.split()
        out += [(i, i + len(p) - 1, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return out


def plain_detections(words, every=rules()):
    """All rules without a gate, all pairs of detections."""
    line = " " + " ".join(words) + " "
    found = []
    for r in every:
        for m in re.finditer(r.pattern.pattern.decode(), line, re.ASCII):
            first = line[:m.start()].count(" ") - 1
            found.append((r.priority, r.label, first, first + m.group().count(" "), r.base))
    return sorted((p, label, a, b) for p, label, a, b, base in found
                  if base or not any(q < p and c <= a and d >= b for q, _, c, d, _ in found))


def detections(text):
    return sorted((r.priority, r.label, a, b) for r, a, b in Scanner().detect(split_words(text.encode())))


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", ["mit"]),
    ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
    ("licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", ["lgpl-2.1"]),
    ("GNU Lesser General Public License v2.1 or later", ["lgpl-2.1"]),
    ("GNU Affero General Public License version 3", ["agpl-3.0"]),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
    ("Creative Commons Attribution-ShareAlike 4.0", ["cc-by-sa"]),
    ("CC BY-NC-ND 4.0", ["cc-by-nc", "cc-by-nc-nd"]),
    ("BSD 3-Clause License", ["bsd-3-clause"]),
    ("new BSD license", ["bsd-3-clause"]),
    ("License: MPL-2.0", ["mpl-2.0"]),
    ("This is free and unencumbered software released into the public domain.", ["unlicense"]),
    ("Alle Rechte vorbehalten. Mit der Lizenz, mit Lizenz", ["all-rights-reserved", "mit"]),
    ("Tous droits réservés", ["all-rights-reserved"]),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
     ["bsd-3-clause"]),
    ("mit dem Zug nach Boston, the apache helicopter, a general public, common public", []),
])
def test_labels(text, labels):
    found = detections(text)
    assert sorted({d[1] for d in found}) == labels
    assert found == plain_detections(plain_words(text))


def test_suppression_by_priority_and_containment():
    got = detections("under the MIT License and the MIT license or CC BY SA")
    assert [d[1:] for d in got if d[1] == "mit"] == [("mit", 0, 3), ("mit", 5, 7)]
    assert [d[1:] for d in got if d[1].startswith("cc")] == [("cc-by-sa", 9, 11)]


def sample(tree, rng):
    """A text that the parsed pattern matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, first = arg[0]
            out += {"LITERAL": lambda: chr(rng.choice(arg)[1]), "RANGE": lambda: chr(rng.randint(*first)), "CATEGORY": lambda: "7" if "DIGIT" in str(first) else "w"}[str(kind)]()
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name == "MAX_REPEAT":
            low, high, what = arg
            out += "".join(sample(what, rng) for _ in range(rng.randint(low, min(high, low + 2))))
    return out


def test_no_match_lacks_a_keyword():
    """The gate never keeps a rule from a text that it would match."""
    rng = random.Random(2)
    for r in rules():
        tree = re._parser.parse(r.pattern.pattern.decode())
        for _ in range(60):
            text = sample(tree, rng).strip()
            if r.pattern.search(b" " + text.encode() + b" "):
                assert r.keywords & set(text.split()), (r.label, text)


def test_query_equals_plain_python(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op11_license_scan"](spark, sf).collect()}
    assert len(got) == len(docs)
    some = 0
    for i, text in docs:
        words, r = plain_words(text), got[i]
        base = plain_base(words)
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert r["first_word"] == min((b[0] for b in base), default=None)
        assert r["last_word"] == max((b[0] for b in base), default=None)
        assert r["base_labels"] == ",".join(sorted({b[2] for b in base}))
        assert r["labels"] == ",".join(sorted({d[1] for d in plain_detections(words)}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
        some += bool(base)
    assert some > 10


def test_odd_rows(spark, rows):
    long = "word " * 200_000 + "under the mit license " * 3000
    data = [(1, None, "a"), (2, "", None), (3, long, "b"), (3, long, "b"), (None, "CC BY-NC", "c"), (5, "Écrit: cc—by—nc", "d")]
    out = scan_licenses(rows(data, "doc_id long, text string, rule string"), carry=["doc_id", "rule"]).collect()
    assert len(out) == 6
    by = {(r["doc_id"], r["rule"]): r for r in out}
    assert by[1, "a"]["n_words"] == 0 and by[1, "a"]["detections"] == [] and by[1, "a"]["score"] == 0
    assert len(by[3, "b"]["detections"]) == 3000 and by[3, "b"]["n_words"] == 212_000
    assert [d["label"] for d in by[None, "c"]["detections"]] == ["cc-by-nc"]
    assert by[5, "d"]["n_words"] == 2 and by[5, "d"]["detections"] == []  # a dash beyond ASCII is part of a word
    assert scan_licenses(rows([])).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(rows([(1, "x", 2.0)], "doc_id long, text string, score double"), carry=["score"])
