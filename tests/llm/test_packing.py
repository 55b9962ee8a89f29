"""Packing: ids against the tokenizer file, an exact round trip, placement."""

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm.packing import best_fit, encoder, pack, sequences
from tallyspark.llm.queries import QUERIES, tokenizer_path


def plain_ids(texts, special_as_text=False):
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = special_as_text
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer():
    rng = np.random.default_rng(2)
    parts = ["the", "of", "straße", "I'll", "12", "3.5", "中文", "\U0001f600", "a_b", "...", "x!!", "\n", "\n\n", "\t", " ",
             "  ", "   ", "\r\n", "\x0b", "\xa0", " ", "²", "'s", "<|endoftext|>", "é", "Ⅻ", "\x1c"]
    texts = ["", " ", "\n", "a  ", "a\n ", "a \n \nb", "a\n\n b", " a", "a \n", "a\n  b"]
    texts += ["".join(str(x) + rng.choice(["", " ", " ", " "]) for x in rng.choice(parts, rng.integers(1, 30)))
              for _ in range(3000)]
    for as_text in (False, True):
        e = encoder(tokenizer_path(), as_text)
        assert e.fast is not None
        for t, want in zip(texts, plain_ids(texts, as_text)):
            assert np.frombuffer(e.encode(t), "<u4").tolist() == want, repr(t)
    assert plain_ids(["a<|endoftext|>b"]) != plain_ids(["a<|endoftext|>b"], True)


def check(packed, docs, capacity, end_id=2):
    """docs: list of (id, text) with distinct ids."""
    ids = dict(zip([i for i, _ in docs], [x + [end_id] for x in plain_ids([t or "" for _, t in docs])]))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, rows in pieces.items():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        at = 0
        for k, r in enumerate(rows):
            part = ids[d][at:at + r["length"]]
            assert r["start"] == at and (k == 0 or r["length"] == capacity) and 1 <= r["length"] <= capacity
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d]) and len(rows) == -(-at // capacity)
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(map(len, ids.values())) // capacity)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check(QUERIES["op5_packing"](spark, sf).collect(), docs, 1024)
    assert used <= 1.02 * least + 1


def test_best_fit_places_every_rank_once():
    rng = np.random.default_rng(4)
    for capacity in (10, 64, 1024):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, capacity + 1, 40), rng.integers(1, 500, 40))}
        runs = best_fit(counts, capacity)
        lengths = np.repeat(sorted(counts, reverse=True), [counts[k] for k in sorted(counts, reverse=True)])
        assert [r[0] for r in runs] == np.cumsum([0] + [r[1] for r in runs])[:-1].tolist()
        assert sum(r[1] for r in runs) == len(lengths)
        full = defaultdict(int)
        for first, n, seq, offset in runs:
            for k in range(n):
                assert full[seq + k] == offset  # gapless, in the order of the runs
                full[seq + k] += int(lengths[first + k])
        assert max(full.values()) <= capacity
        # no sequence is opened while another could hold the piece: at most one is half empty or less
        assert sum(v <= capacity // 2 for v in full.values()) <= 1
    assert best_fit({}, 8) == []


def test_edges_and_round_trip(spark, rows):
    docs = [(1, None), (2, ""), (3, "word " * 5000), (4, "a b"), (5, "a b"), (6, "x" * 50_000), (7, "one <|endoftext|> two")]
    df = rows([(i, t, "clash", 7) for i, t in docs], "doc_id long, text string, ids string, length int")
    packed = pack(df, tokenizer_path(), capacity=64, with_ids=True)
    check(packed.collect(), docs, 64)
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    got = defaultdict(list)
    for r in packed.orderBy("doc_id", "piece").collect():
        got[r["doc_id"]] += whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
    assert dict(got) == {i: x + [2] for (i, _), x in zip(docs, plain_ids([t or "" for _, t in docs]))}
    twice = pack(rows([(1, "a b"), (1, "a b"), (None, "c")]), tokenizer_path())
    assert twice.count() == 3 and twice.select("sequence_id").distinct().count() == 1
    assert twice.agg(F.max("offset")).first()[0] > 0
    assert pack(df.limit(0), tokenizer_path()).count() == 0
