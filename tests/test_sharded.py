"""The classifier with its coefficients in a table against MLlib's."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.operators import categorize as K
from tallyspark.operators import sharded
from tallyspark.operators.sharded import ShardedModel, fit_sharded, predict_sharded


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(3)
    words = {"food": ["pizza", "lunch", "bread"], "rent": ["flat", "house", "march"], "travel": ["bus", "train", "flight"]}
    rows = []
    for i in range(90):
        label = rng.choice(sorted(words))
        text = [rng.choice(words[label if rng.random() < 0.8 else rng.choice(sorted(words))]) for _ in range(4)]
        rows.append((i, " ".join(["paid", *text, f"n{i % 17}"]), label))  # "paid" is in every note
    return spark.createDataFrame(rows, "doc_id long, clean_notes string, category string").cache()


@pytest.mark.parametrize("rows_per_key, partitions", [(1_000_000, 4), (5, 16)])
def test_equals_the_library_fit(spark, notes, rows_per_key, partitions):
    library = K.train_category_model(notes, max_iter=3000, tol=1e-12)
    model = fit_sharded(notes, tol=1e-8, max_iter=200, rows_per_key=rows_per_key, partitions=partitions)
    assert model.labels == ["food", "rent", "travel"]
    assert model.losses == sorted(model.losses, reverse=True)
    want = library.stages[-2].summary.objectiveHistory[-1]
    assert abs(model.losses[-1] - want) < 1e-4
    a = {r.doc_id: r for r in K.predict_category(library, notes).collect()}
    b = {r.doc_id: r for r in K.predict_category(model, notes).collect()}
    assert len(b) == 90
    for i, r in b.items():
        assert r.predicted_category == a[i].predicted_category and abs(r.confidence - a[i].confidence) <= 0.005
    # the optimum fixes every coefficient, not just the predictions
    vocabulary = library.stages[1].vocabulary
    matrix = library.stages[-2].coefficientMatrix.toArray()
    for r in model.coefficients.collect():
        assert max(abs(x - y) for x, y in zip(r.w, matrix[:, vocabulary.index(r.token)])) < 0.02


def test_large_vocabularies_go_to_the_table(spark, notes):
    model = K.train_category_model(notes, max_iter=3, max_coefficients=10)
    assert isinstance(model, ShardedModel) and len(model.losses) <= 4
    out = K.predict_category(model, notes, known=["food"])
    assert set(out.columns) == {"doc_id", "clean_notes", "category", "predicted_category", "confidence"}
    assert {r.predicted_category for r in out.collect()} <= {"food", "Other"}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "red red", "a"), (3, "blue", "b"), (4, "blue x", None), (5, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, clean_notes string, category string")
    model = fit_sharded(df, max_iter=20)
    got = {r.doc_id: r for r in predict_sharded(model, df).collect()}
    assert len(got) == 5 and got[2].predicted_category == "a" and got[3].predicted_category == got[4].predicted_category == "b"
    with pytest.raises(ValueError):
        fit_sharded(df.filter("category IS NULL"))


def test_an_iteration_writes_one_table(spark, notes, monkeypatch):
    written, write = [], sharded.materialize
    monkeypatch.setattr(sharded, "materialize", lambda df, name: written.append(name) or write(df, name))
    model = fit_sharded(notes, tol=1e-12, max_iter=12)
    assert len(model.losses) == 13 and len(written) <= len(model.losses) + 9


def test_notes_meet_neither_by_row_nor_by_id(spark, notes, monkeypatch):
    """Postings aren't shuffled to rows, and the counted model writes none."""
    from tallyspark.plans import q_models
    written, write = [], q_models.materialize
    monkeypatch.setattr(q_models, "materialize", lambda df, name: written.append(name) or write(df, name))
    odd = spark.createDataFrame([(90, "twice bus", "food"), (90, "twice bus bus", "rent"), (None, "lost bus", "food"),
                                 (91, None, "food"), (92, "a", None)], notes.schema)
    model = q_models.counted_model(notes.union(odd))
    assert "seen" not in written
    got = {r.token: (r.idf, r.w) for r in model.coefficients.collect()}
    assert "lost" not in got and "a" not in got
    # both notes of an id count for both of its categories
    assert got["twice"][0] == pytest.approx(math.log(96 / 3) + 1) and got["twice"][1][0] == pytest.approx(math.log(2 / 3))
    out = predict_sharded(model, notes.union(odd))
    assert out.count() == 95 and [r.clean_notes for r in out.filter("doc_id IS NULL").collect()] == ["lost bus"]
    assert "row#" not in "".join(x for x in out._jdf.queryExecution().toString().splitlines() if "hashpartitioning" in x)


def test_a_table_model_is_saved_and_read_again(spark, notes, tmp_path):
    from tallyspark.operators import models as T
    model = K.train_category_model(notes, max_iter=3, max_coefficients=10)
    again = T.load_model(T.save_model(model, str(tmp_path / "m")))
    assert isinstance(again, ShardedModel) and again[1:] == model[1:]
    a, b = (sorted(predict_sharded(m, notes).select("doc_id", "predicted_category", "confidence").collect()) for m in (model, again))
    assert a == b


def test_the_driver_holds_small_models_alone(spark):
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(500)) + f" c{i % 4}", f"c{i % 4}") for i in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, clean_notes string, category string")
    model = K.train_category_model(df, max_iter=2)  # 70,004 tokens, 4 categories
    assert isinstance(model, ShardedModel) and model.coefficients.count() == 70_004


def test_words_are_those_of_the_tokenizer():
    """Split and numbered in Arrow, texts that are not cleaned too."""
    texts = ["red red  blue a b_c", None, "", "Red, BLUE-ish x9\nCafé İst K2", "a b", "_ __ 12"] * 700
    tokens, lens, col, tf = sharded._counted(pa.array(texts))
    tokens, at = tokens.to_pylist(), 0
    assert len(set(tokens)) == len(tokens)
    for text, n in zip(texts, lens):
        got = {tokens[c]: int(t) for c, t in zip(col[at:at + n], tf[at:at + n])}
        assert got == Counter(re.findall(r"\w\w+", (text or "").lower(), re.ASCII))
        at += n
    assert at == len(col)
    shard = sharded._shard_of(pa.array(tokens), 7)
    assert [sharded._shard_of(pa.array([t]), 7)[0] for t in tokens] == shard.tolist() and len(set(shard)) > 3


def test_sums_of_a_block_are_the_matrix_products():
    rng = np.random.default_rng(1)
    lens = rng.integers(0, 5, 40).astype(np.int32)
    col, tf = np.concatenate([rng.choice(30, n, replace=False) for n in lens]).astype(np.int32), rng.integers(1, 4, lens.sum()).astype(np.uint8)
    idf = rng.random(30) + 1
    x = np.zeros((40, 30))
    x[np.repeat(np.arange(40), lens), col] = tf * idf[col]
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    m = sharded._Matrix(lens, col, tf, idf)
    m.step = 7
    r, w = rng.random((40, 3)), rng.random((3, 30))
    np.testing.assert_allclose(m.tokens(r), r.T @ x, atol=1e-14)
    np.testing.assert_allclose(m.rows(w), x @ w.T, atol=1e-14)
    own, part = np.flatnonzero(col > 20), np.zeros((3, 30))
    m.add(part, r, own)
    np.testing.assert_allclose(part[:, 21:], (r.T @ x)[:, 21:], atol=1e-14)


def test_words_of_a_large_model_are_found_once(spark, notes, monkeypatch):
    def second_time(*a, **k):
        raise AssertionError("the words are found a second time")

    monkeypatch.setattr(K, "RegexTokenizer", second_time)
    assert isinstance(K.train_category_model(notes, max_iter=1, max_coefficients=10), ShardedModel)


def test_one_category_and_notes_without_words(spark):
    one = fit_sharded(spark.createDataFrame([(1, "red red", "a"), (2, "blue", "a")], "doc_id long, clean_notes string, category string"))
    assert sorted((r.token, list(r.w)) for r in one.coefficients.collect()) == [("blue", [0.0]), ("red", [0.0])]
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, "x", "b")], "doc_id long, clean_notes string, category string")
    model = fit_sharded(df)
    assert model.coefficients.count() == 0
    assert {(r.predicted_category, r.confidence) for r in predict_sharded(model, df).collect()} == {("b", 0.667)}


def test_rows_meet_few_categories_without_a_shuffle(spark, notes):
    plan = K.keep_frequent_categories(notes, 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
