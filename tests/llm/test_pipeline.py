"""The pipeline against its stages in plain Python over a small table."""

import os
import random

import pytest

import corpus_pipeline
from test_exact import plain_contamination, plain_lines
from test_packing import check
from test_simhash import plain_components, plain_fingerprint

WORDS = {"en": "the of and to in that with for was this from have which there their".split(),
         "fr": "le la les des une dans pour que est avec sur plus par être cette".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    docs = []
    for i in range(160):
        lang = rng.choice(["en", "fr"])
        lines = [" ".join(rng.choices(WORDS[lang], k=rng.randint(4, 12))) for _ in range(rng.randint(1, 6))]
        docs.append([i, "\n".join(lines), lang])
    for i in (10, 20, 30, 40):
        docs[i][1] += "\nThe Line that Repeats across documents"
    for i in (5, 6):  # two copies: too few for their lines to go
        docs[i + 45][1] = docs[i][1]
    bench = [(1, " ".join(f"item{k}" for k in range(20))), (2, "one two three")]
    docs[60][1] += " " + bench[0][1]
    docs[61][1] = "one two three " + docs[61][1] * 40
    docs[70][1], docs[71][1], docs[72][1] = "12 34", "", None
    root = str(tmp_path_factory.mktemp("pipeline"))
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(os.path.join(root, "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(os.path.join(root, "benchmark.parquet"))
    return root, [(i, t) for i, t, _ in docs], bench


def test_pipeline_equals_its_stages(spark, folder):
    root, docs, bench = folder
    got = corpus_pipeline.run(spark, root).collect()
    left = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]  # every other text is one language's
    left = [(i, t) for i, _, _, t in plain_lines(left)]
    roots = plain_components([(i, plain_fingerprint(t)) for i, t in left])
    left = [(i, t) for i, t in left if roots[i] == i]
    assert not {50, 51} & {i for i, _ in left} and {5, 6} <= {i for i, _ in left}
    clean = []
    for i, t in left:
        n, hit, _ = plain_contamination(t, bench)
        if not (hit and 20 * hit >= n):
            clean.append((i, t))
    ids = {i for i, _ in clean}
    assert 60 not in ids and 61 in ids
    check(got, clean, 1024)


def test_stages_keep_the_columns(spark, folder):
    root = folder[0]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "line_dedup" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.dtypes == spark.read.parquet(f"{root}/documents.parquet").dtypes
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_tables(spark, folder):
    root = folder[0]
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (None, "the of and", "en", None, 3),
                                 (4, "the of and to", "en", "s", 1), (4, "the of and to", "en", "s", 1)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, root).count() <= 5
