"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch
from tallyspark.llm.conversation_trie import ends_digest, prefix_trie, subtree_totals
from tallyspark.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows, family=None):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in convs.items():
        if family:
            h = zlib.crc32(str(c).encode()) % 6
            lead = c - (c % family if c >= 0 else -(-c % family))
            turns = convs.get(lead, [])[:h] + turns[h:]
        built[c] = tuple(turns)
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(convs, family=None, piece_ids=3):
    nodes, ends = prefix_trie(convs, family=family)
    empty = hashlib.sha256(b"").hexdigest()
    out = (nodes.join(ends_digest(ends, piece_ids), ["conv_id", "depth"], "left")
           .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
           .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    return sorted(map(tuple, out.collect()))


def random_rows(seed, convs, vocabulary=2, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(0, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "é" * rng.randint(1, vocabulary)))
    rng.shuffle(rows)
    return rows


def test_query_equals_sql(spark, sf, duck):
    from harness import compare
    r = compare(spark, duck, "op12", QUERIES["op12_conversation_trie"], ORACLE["op12_conversation_trie"], sf)
    assert "error" not in r, r


@pytest.mark.parametrize("family", [None, 100])
def test_equals_plain_python(spark, rows, family):
    data = random_rows(4, [*range(-120, 40, 3), *range(95, 330, 2)])
    assert found(rows(data, SCHEMA), family) == plain_trie(data, family)


def test_a_conversation_over_many_tasks(spark, rows):
    """One conversation holds a third of all rows and lies in many parts; a
    copy shares most of its turns; very many identical ones."""
    data = random_rows(7, range(60))
    data += [(1000, t, "user", f"turn {t % 7}") for t in range(300)]
    data += [(1003, t, "user", f"turn {t % 7}" if t < 250 else "x") for t in range(260)]
    data += [(c, t, "user", "same" * (t + 1)) for c in range(2000, 2040) for t in range(3)]
    assert found(rows(data, SCHEMA).repartition(11), 100) == plain_trie(data, 100)


def test_odd_rows(spark, rows):
    data = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "", ""), (2, 0, "user", "a"),
            (None, 1, "user", "gone"), (3, 5, "user", "long " * 100_000), (3, 7, None, "b"), (4, 5, "user", "long " * 100_000)]
    got = found(rows(data, SCHEMA))
    assert got == plain_trie(data)
    clash = rows(data, SCHEMA).selectExpr("*", "conv_id AS conv", "turn AS depth", "text AS part")
    assert found(clash) == got


def test_empty_and_turnless(spark, rows):
    assert found(rows([], SCHEMA), 100) == []
    only = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0][:3]
    data = [(c, 0, "user", "hi") for c in only]  # no leading conversation: nothing left
    got = found(rows(data, SCHEMA), 100)
    assert got == plain_trie(data, 100) and len(got) == 1 and got[0][3] == 3


def test_contraction_rounds_grow_slowly(spark):
    """A chain of 600 nodes with a bush at its end: few rounds, right sums."""
    tree = [(0, d, 0 if d else None, 1, 0, d) for d in range(600)]
    tree += [(k, 600, 0, 0, 1, k) for k in range(50)]
    tree[599] = (0, 599, 0, 50, 0, 599)
    df = spark.createDataFrame(tree, "conv long, depth long, parent long, kids long, leaves long, saved long")
    scratch = Scratch(spark, "test-trie")
    got = {(r["conv"], r["depth"]): (r["leaves"], r["saved"]) for r in subtree_totals(df, scratch).collect()}
    bush = sum(range(50))
    assert len(got) == 650
    for d in range(600):
        assert got[0, d] == (50, sum(range(d, 600)) + bush)
    import os
    assert len([x for x in os.listdir(scratch.base.removeprefix("file:")) if x.startswith("total-")]) <= 16
