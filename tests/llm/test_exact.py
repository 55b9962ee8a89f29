"""Operators with an SQL form: the query over a whole table, then edges."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from harness import compare

from tallyspark.llm.decontaminate import FMIndex, find_contamination, words_of
from tallyspark.llm.embedding_dedup import calibrate, near_vectors
from tallyspark.llm.line_dedup import dedup_lines
from tallyspark.llm.queries import ORACLE, QUERIES
from tallyspark.llm.substring import dedup_substrings


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf, name):
    got = compare(spark, duck, name, QUERIES[name], ORACLE[name], sf)
    assert "error" not in got, got


# --- decontamination ---------------------------------------------------------

def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    for size, sigma in ((60, 2), (500, 3), (2000, 40)):
        text = rng.integers(0, sigma + 1, size)
        text[size // 3:2 * size // 3] = text[:2 * size // 3 - size // 3]  # a long repeat
        text[-1] = 0
        index = FMIndex(text, sample=4)
        for m in (1, 2, 5):
            patterns = rng.integers(1, sigma + 2, (50, m))
            lo, hi = index.find(patterns)
            for p, a, z in zip(patterns, lo, hi):
                want = [i for i in range(size - m + 1) if (text[i:i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def plain_contamination(text, items, window=13):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")
    words = [w for w in split(text) if w]
    hit, found = set(), set()
    for i, t in items:
        ws = [w for w in split(t) if w]
        for j in range(max(1, len(ws) - window + 1) if ws and i is not None else 0):
            p = ws[j:j + window]
            for k in range(len(words) - len(p) + 1):
                if words[k:k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(i)
    return len(words), len(hit), sorted(found)


def test_contamination_edges(spark, rows):
    items = [(1, "A b c"), (2, " ".join(f"w{i}" for i in range(20))), (3, None), (4, ""), (5, "!!"), (6, "a b c"),
             (2, "é É x"), (None, "never mind"), (7, "w3")]
    docs = [(1, "x a B c y a b c"), (2, " ".join(f"W{i}" for i in range(2, 18)) + " z"), (3, None), (4, ""),
            (5, "é É x"), (6, "never mind"), (7, "a b. c-a b c"), (7, "a b. c"), (None, "w3, w3"),
            (9, "a b c " * 30_000), (10, "w3 " + "q " * 50)]
    df = rows([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for block_words, symbols in ((1 << 18, 1 << 20), (4, 64)):
        got = find_contamination(df, bench, block_words=block_words, shard_symbols=symbols).collect()
        assert len(got) == len(docs)
        have = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got)
        want = Counter()
        for i, t in docs:
            n, hit, found = plain_contamination(t if i != 9 else "a b c " * 3, items)
            want[i, n * (1 if i != 9 else 10_000), hit * (1 if i != 9 else 10_000), tuple(found)] += 1
        assert have == want
        assert all(s["start"] < s["end"] for r in got for s in r["spans"])
    assert find_contamination(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert find_contamination(df.limit(0), bench).count() == 0


def test_words_end_at_other_ascii():
    assert words_of("A_b-c\td9É x".encode()) == [b"a", b"b", b"c", "d9É x".encode()]


# --- line dedup --------------------------------------------------------------

def plain_lines(docs):
    ws = " \t\n\x0b\x0c\r"

    def key(x):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(ws))
    where = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                where.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= 3}
    out = Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_edges(spark, rows, monkeypatch):
    from tallyspark.llm import line_dedup
    long, accents = "This Line is Long Enough", "é" * 20
    docs = [(1, f"{long}\nshort\n{long}"), (2, f"  {long.upper()}\t\r\nx"), (3, f"\x0b{long}"), (4, f"{accents}\nÉ{accents}"),
            (5, accents), (6, accents + "\n"), (7, None), (8, ""), (None, long), (9, "short\nshort"), (1, f"{long}\nagain"),
            (10, " " + long), (11, "line of thirty characters here\n" * 20_000), (12, "line of thirty characters here"),
            (13, "Line of thirty characters here\nend")]
    df = rows([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, digest string, n_lines int")
    for bits in (None, 512):  # a full filter suspects every line; the result stays
        if bits:
            monkeypatch.setattr(line_dedup, "MIN_BITS", bits * 8)
            monkeypatch.setattr(line_dedup, "MAX_BITS", bits * 8)
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(df).collect())
        assert got == plain_lines(docs)
    assert dedup_lines(df.limit(0)).count() == 0


# --- substring dedup ---------------------------------------------------------

def plain_substrings(docs, window):
    first = {}
    words = [(i, (t or "").replace("\x0b", " ").replace("\x0c", " ").split(None) if t else []) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            s = tuple(w[k:k + window])
            first[s] = min(first.get(s, i), i)
    out = Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("window", [6, 7])
def test_substrings_equal_all_windows(spark, rows, window):
    rng = np.random.default_rng(window)
    passages = [[f"p{j}w{k}" for k in range(n)] for j, n in enumerate((5, 6, 7, 9, 14, 30))]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.integers(0, 6)):
            w += [f"u{x}" for x in rng.integers(0, 40, rng.integers(0, 12))]
            p = passages[rng.integers(len(passages))]
            w += p[rng.integers(0, 2):len(p) - rng.integers(0, 2)]
        docs.append((int(rng.permutation(1000)[0]) if i % 7 else i, " \n".join(w)))
    docs += [(2000, docs[3][1]), (2001, docs[3][1]), (2002, "z " * 300), (2003, "z " * 200), (2004, None), (2005, ""),
             (None, docs[3][1]), (2001, docs[3][1]), (2001, "other text")]
    df = rows([(i, t, 1) for i, t in docs], "doc_id long, text string, anchor int")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])
                  for r in dedup_substrings(df, window=window).collect())
    assert got == plain_substrings(docs, window)
    assert dedup_substrings(df.limit(0)).count() == 0


# --- embeddings --------------------------------------------------------------

def plain_vectors(data, limit=0.98):
    ok = [k for k, (i, v, lab) in enumerate(data) if i is not None and lab is not None and v
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(data))}
    for a in ok:
        for b in ok:
            x, y = (np.array(data[k][1], dtype=np.float32).astype(float) for k in (a, b))
            if a != b and data[a][2] == data[b][2] and len(x) == len(y):
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= limit:
                    near[a].add(b)
    out = Counter()
    for k, (i, _, _) in enumerate(data):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[i, len(near[k]), min((data[j][0] for j in seen if data[j][0] is not None), default=None)] += 1
    return out


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    data = []
    for c in range(30):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            data.append((centre + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.15, 0.4]) * 0.9).tolist())
    data = [(i, v, i % 2) for i, v in enumerate(data)]
    same = [float(x) for x in data[0][1]]
    data += [(900 + k, same, 0) for k in range(20)] + [(950, [2 * x for x in same], 0), (951, same, None),
             (952, None, 0), (953, [0.0] * 16, 0), (954, [float("nan")] + same[1:], 0), (955, [], 0),
             (956, [None] + same[1:], 0), (957, same[:8], 0), (957, same[:8], 0), (958, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in data],
                               "vec_id long, embedding array<float>, label int, rep int")
    for block in (512, 4):
        got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(df, block=block).collect())
        assert got == plain_vectors(data)
    assert near_vectors(df.limit(0)).count() == 0


def test_calibration_reaches_the_recall():
    width, need = calibrate(0.98, 20, 4.5, 0.9999)
    rng = np.random.default_rng(0)
    gap = np.abs(rng.standard_normal((200_000, 20))) * np.sqrt(2 - 2 * 0.98)
    hit = gap <= width
    assert (hit[:, :3].all(axis=1) & (hit.sum(axis=1) >= need)).mean() >= 0.9998


def test_digest_columns(spark, sf):
    r = QUERIES["op7_line_dedup"](spark, sf).first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
