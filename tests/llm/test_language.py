"""Language ID: code lengths against a plain model, held-out accuracy, edges."""

import math
from collections import Counter, defaultdict

import numpy as np

from tallyspark.llm.language import GROUP, Model, Models, identify, train
from tallyspark.llm.queries import QUERIES


def plain_bits(train_text: bytes, text: bytes, order=3) -> float:
    """Code length with exclusion, straight from the definition."""
    follow = defaultdict(Counter)
    padded = b"\n" * order + train_text
    for i in range(order, len(padded)):
        for k in range(order + 1):
            follow[padded[i - k:i]][padded[i]] += 1
    data, bits = b"\n" * order + text, 0.0
    for i in range(order, len(data)):
        chance, out, c = 1.0, set(), data[i]
        for k in range(order, -1, -1):
            f = {s: n for s, n in follow.get(data[i - k:i], {}).items() if s not in out}
            if not f:
                continue
            total, kinds = sum(f.values()), len(f)
            if c in f:
                chance *= f[c] / (total + kinds)
                break
            chance *= kinds / (total + kinds)
            out |= set(f)
        else:
            chance /= 256 - len(out)
        bits -= math.log2(chance)
    return bits


def grams_of(texts, order=3):
    grams = {}
    for lang, t in texts.items():
        p = b"\n" * order + t
        c = Counter(int.from_bytes(p[i - order:i + 1], "big") for i in range(order, len(p)))
        keys = sorted(c)
        grams[lang] = (np.array(keys, dtype=np.int64), np.array([c[k] for k in keys], dtype=np.int64))
    return grams


def model_of(texts, order=3):
    return Model(sorted(texts), grams_of(texts, order), order, 1, 10**6)


def test_forty_languages_keep_their_own_contexts():
    rng = np.random.default_rng(4)
    texts = {}
    for i in range(40):
        letters = rng.choice(list(b"abcdefghijklmnopqrstuvwxyz "), 12, replace=False)
        texts[f"l{i:02d}"] = bytes(rng.choice(letters, 1500, p=rng.dirichlet(np.ones(12))).tolist())
    grams, langs = grams_of(texts), sorted(texts)
    every = Models(langs, grams, 3, 3, 150)
    assert len(every.groups) == -(-len(langs) // GROUP)
    asked = [texts["l07"][:200], texts["l31"][-90:], b"", b"\xff zz"]
    got = every.code_lengths(asked)
    for j, lang in enumerate(langs):
        alone = Models([lang], grams, 3, 3, 150)
        assert len(alone.groups[0].child) - 1 <= 151
        assert np.allclose(alone.code_lengths(asked)[:, 0], got[:, j], rtol=1e-4, atol=0.5), lang
    assert langs[got[0].argmin()] == "l07" and langs[got[1].argmin()] == "l31"


def test_code_lengths_equal_the_definition():
    texts = {"a": b"abracadabra abra cadabra", "b": "die straße in die stadt".encode()}
    m = model_of(texts)
    asked = [b"abra", b"die stadt", "straße ab xyz\x00".encode(), b"", b"a" * 50]
    got = m.code_lengths(asked)
    for i, t in enumerate(asked):
        for j, lang in enumerate(sorted(texts)):
            assert abs(got[i, j] - plain_bits(texts[lang], t)) < 1e-3 * (1 + len(t)), (t, lang)


def test_steps_do_not_change_the_sums(monkeypatch):
    from tallyspark.llm import language
    m = model_of({"a": b"abracadabra", "b": b"banana bandana"})
    asked = [b"banana", b"", b"abra" * 30, b"x", b"band"]
    whole = m.code_lengths(asked)
    monkeypatch.setattr(language, "STEP", 7)
    assert np.allclose(whole, m.code_lengths(asked), atol=1e-3)


def test_held_out_accuracy(spark, sf):
    got = QUERIES["op4_language_id"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_edges(spark, rows):
    df = rows([(1, "der die das und", "de", "x"), (2, "the of and to", "en", "x"), (3, None, "en", "x"),
               (4, "", None, "x"), (5, "12 34 !!", None, "x"), (None, "the and", None, "x"),
               (2, "the of and to", "en", "x"), (7, "the of " * 100_000, None, "x")],
              "doc_id long, text string, lang string, score string")
    m = train(df, "text", "lang", "doc_id", least=1)
    got = [(r["doc_id"], r["lang_pred"]) for r in identify(df, m).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (2, "en"), (7, "en")], key=str)
    assert identify(df.limit(0), m).count() == 0
    assert train(df.limit(0), "text", "lang", "doc_id") is None
    assert {r["lang_pred"] for r in identify(df, None).collect()} == {"und"}
