"""SimHash against all pairs in plain Python."""

import duckdb
import numpy as np
import xxhash

from tallyspark.llm.common import Scratch
from tallyspark.llm.queries import QUERIES
from tallyspark.llm.simhash import fingerprint, group_fingerprints, near_duplicates

SPACES = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in SPACES else c
                                for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    """fps: list of (id, fingerprint) -> smallest id reachable."""
    ids = sorted(fps, key=lambda x: x[0])
    root = {}
    left = list(range(len(ids)))
    while left:
        first = left.pop(0)
        group, todo = [first], [first]
        while todo:
            a = todo.pop()
            near = [b for b in left if (ids[a][1] ^ ids[b][1]).bit_count() <= radius]
            left = [b for b in left if b not in set(near)]
            group += near
            todo += near
        for g in group:
            root[ids[g][0]] = ids[first][0]
    return root


def test_query_equals_all_pairs(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    roots = plain_components(fps)
    got = QUERIES["op10_simhash"](spark, sf).collect()
    assert len(got) == len(docs)
    want = {d: (f"{f:016x}", roots[d]) for d, f in fps}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    assert len(set(roots.values())) < len(roots)


def test_small_blocks_and_chains_lose_no_link(spark, rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = []
    for b in base:  # chains: each step flips up to three bits of the one before
        x = int(b)
        for _ in range(6):
            fps.append(x)
            for bit in rng.integers(0, 64, 3):
                x ^= 1 << int(bit)  # unsigned
    fps += fps[:20]
    table = dict(enumerate(fps))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in table.items()]
    got = group_fingerprints(rows(signed, "__id long, fp long"), Scratch(spark, "test"), block=8).collect()
    assert {r["__id"]: r["component_id"] for r in got} == plain_components(list(table.items()))


def test_edges(spark, rows):
    df = rows([(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "One two", "x"), (5, "one  TWO", "x"),
               (6, "É b c d", "x"), (6, "É b c d", "x"), (None, "é b c d", "x"), (8, "w " * 200_000, "x")],
              "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in near_duplicates(df).collect()]
    assert len(got) == 9
    by = {g[0]: g for g in got}
    assert by[1][1:] == by[2][1:] == by[3][1:] == (0, 1)
    assert by[4][2] == by[5][2] == 4 and by[6][2] == 6 and by[8][2] == 8
    assert fingerprint("É b c d".encode()) != fingerprint("é b c d".encode())
    assert near_duplicates(rows([])).count() == 0
