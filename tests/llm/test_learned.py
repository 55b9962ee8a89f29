"""Operators with fitted models: rules by hand, held-out accuracy, edges."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import masked_lm, quality, toxicity
from tallyspark.llm.decontaminate import words_of
from tallyspark.llm.labelled import labelled_sample
from tallyspark.llm.queries import QUERIES

ODD = [(1, None), (2, ""), (3, " \n "), (4, "!!!"), (4, "!!!"), (None, "the of"), (7, "the of and " * 60_000)]


def held_out_rows(spark, sf, name, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("y"))
    return QUERIES[name](spark, sf).join(labels, "doc_id").filter("held_out AND y IS NOT NULL").collect()


def test_quality_held_out(spark, sf):
    got = QUERIES["op2_quality"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.count() == n and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert got.filter("predicted != cast(score >= 0.7 AS int)").count() == 0
    rows = held_out_rows(spark, sf, "op2_quality", "quality")
    assert sum(r["predicted"] == r["y"] for r in rows) / len(rows) > 0.9


def test_ftrl_step_equals_the_definition():
    m = quality.Ftrl(8, rate=0.5, smooth=1.0, l1=0.1, l2=0.2)
    z, n = [0.0] * 9, [0.0] * 9
    rng = random.Random(1)
    for _ in range(50):
        at = sorted(rng.sample(range(8), 3)) + [8]
        x, y = [rng.random() for _ in range(3)] + [1.0], rng.randint(0, 1)
        w = []
        for i in at:
            l1, l2 = (0.0, 0.0) if i == 8 else (0.1, 0.2)
            w.append(0.0 if abs(z[i]) <= l1 else
                     -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + l2))
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, wi, xi in zip(at, w, x):
            g = (p - y) * xi
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * wi
            n[i] += g * g
        m.step(np.array(at), np.array(x), y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_quality_edges(spark, rows):
    df = rows([(i, t, 0.5) for i, t in ODD], "doc_id long, text string, score double")
    none = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert {r["score"] for r in quality.score(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (4, None), (7, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    w = quality.train(df, labels, "quality")
    got = quality.score(df, w).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score(df.limit(0), w).count() == 0


def test_sample_is_bounded(spark, rows):
    df = rows([(i, f"t{i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1)], "doc_id long, y int")
    assert labelled_sample(df, labels, "y", 50, 1).count() <= 50
    assert labelled_sample(df, labels, "y", 500, 1).count() == 200


# --- toxicity -----------------------------------------------------------------

def grammar():
    return toxicity.Grammar({"idiot": 4.0, "scum": 3.0, "low$": 2.0})


@pytest.mark.parametrize("text, kinds", [
    ("An idiot here.", ["plain"]),
    ("You are an idiot!", ["aimed"]),
    ("You are not an idiot", ["negated"]),
    ("He said you are idiots", ["reported"]),
    ("He said so. You idiot", ["aimed"]),
    ("never mind these four words idiot", ["aimed"]),
    ("We will kill them", ["threat"]),
    ("You will burn", ["threat"]),
    ("Not kill them", ["threat negated"]),
    ("The report: kill the process", []),
    ("scum, idiot; SCUM", ["plain", "plain", "plain"]),
    ("low lower", ["plain"]),
    ("idioms are fine", []),
    (None, []), ("", []),
])
def test_grammar_matches(text, kinds):
    assert [k for _, k, _ in grammar().matches(text)] == kinds


def test_composition_equals_the_machines():
    step, out = toxicity.compose()
    rng = random.Random(3)
    for _ in range(300):
        state, product = 0, (0,) * len(toxicity.MACHINES)
        for c in rng.choices(range(toxicity.CLASSES), k=12):
            after = tuple(m(s, c) for m, s in zip(toxicity.MACHINES, product))
            kind = toxicity._match(product, after, c)
            assert out[state, c] == (toxicity.KINDS.index(kind) if kind else -1)
            state, product = step[state, c], after


@pytest.mark.parametrize("text, kinds", [
    ("You don't look like an idiot", ["negated"]),
    ("You don\u2019t seem an idiot", ["negated"]),
    ("He doesn't strike me as an idiot", ["negated"]),
    ("You are an idiot, he said", ["reported"]),
    ("\u201cyou are an idiot\u201d the old man said", ["reported"]),
    ("you are dead meat, I will strangle you", ["threat", "threat"]),
    ("No, you are an idiot", ["aimed"]),
    ("You're an idiot", ["aimed"]),
    ("C'est l'idiot", ["plain"]),
    ("Il n'est pas un idiot", ["negated"]),
    ("scum, idiot, she wrote", ["reported", "reported"])])
def test_scopes_and_forms(text, kinds):
    assert [k for _, k, _ in grammar().matches(text)] == kinds


def test_inflections():
    assert toxicity.inflect("stab", "en") == ["stab", "stabs", "stabbing"]
    assert toxicity.inflect("strangle", "en") == ["strangle", "strangles", "strangling"]
    assert toxicity.inflect("beat", "en") == ["beat", "beats", "beating"]
    assert toxicity.inflect("punch", "en")[1] == "punches"
    assert {"töte", "tötest", "tötet", "töten"} <= set(toxicity.inflect("töten", "de"))
    assert {"tue", "tuera"} <= set(toxicity.inflect("tuer", "fr"))
    assert {"mato", "matará"} <= set(toxicity.inflect("matar", "es"))


def test_context_lowers_the_score():
    g = grammar()
    s = [g.score(t) for t in ("You are an idiot", "An idiot", "You are not an idiot", "A fine day")]
    assert s == sorted(s, reverse=True) and len(set(s)) == 4


def test_stems_are_drawn_out_and_rare_ones_left():
    counts = {"low": (320, 318), "lowe": (318, 318), "lowei": (318, 318), "loweia": (60, 60), "the": (900, 90),
              "rar": (3, 3), "idi": (50, 48), "idio": (49, 48), "idiot": (48, 48), "idiot$": (48, 48)}
    assert set(toxicity.choose_stems(counts)) == {"lowei", "idiot"}


def test_toxicity_edges(spark, rows):
    df = rows([(i, t, 0.5) for i, t in ODD], "doc_id long, text string, score double")
    g = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert g.stems == {}
    got = toxicity.score(df, g).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.3 or r["score"] <= 1 for r in got)
    assert toxicity.score(df.limit(0), g).count() == 0


def test_toxicity_learns_stems(spark, rows):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 6)))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(40)] = "zork" + rng.choice(["a", "ib", "", "um"])
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 5 == 0)))
    docs.append((1000, "aeio zorkest lmn."))
    df = rows(docs)
    g = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, g).collect()}
    assert list(g.stems) == ["zork"] and got[1000] >= 0.3
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels)


def test_toxicity_query(spark, sf):
    got = QUERIES["op9_toxicity"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.filter("score < 0 OR score > 1 OR predicted != cast(score >= 0.3 AS int)").count() == 0
    rows = held_out_rows(spark, sf, "op9_toxicity", "toxic")
    assert sum(r["predicted"] == r["y"] for r in rows) / len(rows) > 0.85


# --- masked LM -------------------------------------------------------------------

def tiny_network():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 50, masked_lm.VOCAB).astype(float)
    net = masked_lm.Network([b"a", b"b", b"c"], n)
    for k in net.w:
        net.w[k] = net.w[k] + rng.standard_normal(net.w[k].shape).astype(np.float32) * 0.3
    return net


def plain_log_prob(net, ids, i):
    side = masked_lm.SIDE
    h = np.zeros(masked_lm.HIDDEN)
    for k, d in enumerate([*range(-side, 0), *range(1, side + 1)]):
        j = i + d
        h += net.w["see"][k][ids[j] if 0 <= j < len(ids) else 0]
    h = np.tanh(h)
    c, k = divmod(ids[i], masked_lm.CLASS)
    z = h @ net.w["class"] + net.w["class0"]
    y = h @ net.w["word"][c] + net.w["word0"][c]
    return z[c] - np.log(np.exp(z).sum()) + y[k] - np.log(np.exp(y).sum())


def test_log_probs_equal_the_definition():
    net = tiny_network()
    texts = [b"a b c d a", None, b"", b"e", b"a a a a a a a a"]
    ids, sizes = net.encode(texts)
    at, doc = masked_lm._places(sizes)
    got = net.log_probs(ids, at)
    for d, t in enumerate(texts):
        own = [net.ids[w] for w in (t or b"").split()]
        assert np.allclose(got[doc == d], [plain_log_prob(net, own, i) for i in range(len(own))], atol=1e-3)


def test_learning_follows_the_gradient():
    net = tiny_network()
    ids, sizes = net.encode([b"a b c a b c a b c a b c"] * 40)
    at, _ = masked_lm._places(sizes)
    before, memory = net.log_probs(ids, at).mean(), net.fresh_memory()
    for _ in range(20):
        net.learn(ids, at, memory)
    assert net.log_probs(ids, at).mean() > before + 0.5


def test_scores_order_texts_and_edges(spark, rows):
    rng = random.Random(2)
    say = lambda n: " ".join("red fox runs over green hill".split() * n)
    docs = [(i, say(rng.randint(2, 6)), 0.0) for i in range(300)] + [(500 + i, t, 0.0) for i, (_, t) in enumerate(ODD)]
    shuffled = say(4).split()
    rng.shuffle(shuffled)
    docs += [(900, say(4), 0.0), (901, " ".join(shuffled), 0.0), (902, "quartz vex nymph " * 8, 0.0)]
    df = rows(docs, "doc_id long, text string, log_prob double")
    net = masked_lm.train(df.filter("doc_id < 600"), share=0.5)
    got = {r["doc_id"]: r for r in masked_lm.score(df, net).collect()}
    assert len(got) == len(docs)
    assert got[900]["mean_log_prob"] > got[901]["mean_log_prob"] > got[902]["mean_log_prob"]
    assert (got[500]["n_words"], got[500]["log_prob"], got[500]["mean_log_prob"]) == (0, 0.0, None)
    assert got[506]["n_words"] == 180_000
    assert masked_lm.score(df.limit(0), net).count() == 0
    assert masked_lm.train(df.limit(0)).log_probs(*[np.zeros(7, dtype=np.int32), np.array([3])]).shape == (1,)


def test_lm_query_beats_word_frequencies(spark, sf):
    got = QUERIES["op3_lm_scoring"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    net = masked_lm.train(docs, rounds=0)  # word frequencies alone
    base = masked_lm.score(docs, net)
    a, b = (x.agg(F.sum("log_prob") / F.sum("n_words")).first()[0] for x in (got, base))
    assert a > b and got.count() == docs.count()


def test_words_of_a_place_differ_and_sum_to_one(spark, rows):
    texts = [" ".join(f"w{i} " * (1 + i % 5) for i in range(j, 4000, 7)) for j in range(7)]
    net = masked_lm.train(rows(list(enumerate(texts))), rounds=0)
    n = {f"w{i}".encode(): 1 + i % 5 for i in range(4000)}
    shared = [w for w in n if net.ids[w] >= net.size - masked_lm.BUCKETS]
    place = np.array([net.ids[w] for w in shared]) - (net.size - masked_lm.BUCKETS)
    inner = net.tail.known(shared, place)
    once = np.bincount(place, weights=[n[w] == 1 for w in shared], minlength=masked_lm.BUCKETS)
    total = np.bincount(place, weights=[n[w] for w in shared], minlength=masked_lm.BUCKETS)
    want = [math.log(n[w] / (total[p] + max(once[p], 1))) for w, p in zip(shared, place)]
    assert len(shared) == 4000 - (masked_lm.VOCAB - masked_lm.BUCKETS - 1) and np.allclose(inner, want)
    spare = np.exp(net.tail.reserve)
    assert np.allclose(np.bincount(place, weights=np.exp(inner), minlength=masked_lm.BUCKETS) + spare, 1)
    got = {r["text"]: r["log_prob"] for r in masked_lm.score(
        rows([(0, shared[0].decode()), (1, "zzqx")], "text_id long, text string").withColumn("doc_id", F.col("text_id")),
        net).join(rows([(0, shared[0].decode()), (1, "zzqx")]), "doc_id").collect()}
    assert got["zzqx"] < got[shared[0].decode()] - 5  # a word never counted


def test_joined_counts_equal_the_held_ones(spark, rows, monkeypatch):
    rng = random.Random(4)
    df = rows([(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 9000}" for _ in range(200))) for i in range(60)]
              + [(None, "w1 never never seen"), (70, None)])
    seen = df.filter("doc_id IS NOT NULL")
    held = masked_lm.score(df, masked_lm.train(seen, rounds=0)).collect()
    monkeypatch.setattr(masked_lm, "HELD_COUNTS", 500)
    net = masked_lm.train(seen, rounds=0)
    # other places, equal sums: a word's chance is its count either way
    assert not net.tail.whole and len(net.ids) + len(net.tail.counts) <= 500
    joined = {r["doc_id"]: r for r in masked_lm.score(df, net).collect()}
    assert len(joined) == len(held) == 62
    assert joined[70]["log_prob"] == 0.0 and all(r["n_words"] == joined[r["doc_id"]]["n_words"] for r in held)
    # the same network holding all counts scores alike
    counts = {bytes(r["word"]): math.log(r["n"]) for r in spark.read.parquet(net.tail.path).collect()}
    net.tail.counts, net.tail.whole = counts, True
    for r in masked_lm.score(df, net).collect():
        assert abs(r["log_prob"] - joined[r["doc_id"]]["log_prob"]) < 1e-6 * 200


def test_vocabulary_grows_with_the_corpus():
    sizes = [masked_lm.places_for(n) for n in (0, 10**6, 10**8, 10**10)]
    assert sizes[:2] == [(masked_lm.VOCAB, masked_lm.CLASS)] * 2
    assert sizes[1][0] < sizes[2][0] < sizes[3][0] and all(a % b == 0 for a, b in sizes)




def test_every_document_trains_once(spark, rows, monkeypatch):
    df = rows([(i, f"a b w{i}") for i in range(200)] + [(None, "x y"), (300, None)])
    told = []
    monkeypatch.setattr(masked_lm, "_merge", lambda out, n: told.append(
        out.filter("name = 'class0'").agg(F.sum("seen")).first()[0] or 0) or [])
    masked_lm.train(df)
    assert sum(told) == 602 and len(told) == masked_lm.ROUNDS


SCORES = """
import sys
sys.path.insert(0, {root!r})
from tallyspark.llm import masked_lm
from tallyspark.session import build_session
masked_lm.LEARNER_WORDS = 200
spark = build_session("cores", cores=2, shuffle_partitions=3)
df = spark.createDataFrame([(i, " ".join(f"w{{i * k % 37}}" for k in range(1, 30))) for i in range(120)], "doc_id long, text string")
for r in sorted(masked_lm.score(df, masked_lm.train(df)).collect()):
    print("SCORE", r[0], repr(r[2]))
"""


def test_scores_do_not_depend_on_cores_or_partitions(spark, rows, monkeypatch):
    import os
    import subprocess
    import sys
    monkeypatch.setattr(masked_lm, "LEARNER_WORDS", 200)
    assert masked_lm.learners_for(3480) > 4
    df = rows([(i, " ".join(f"w{i * k % 37}" for k in range(1, 30))) for i in range(120)])
    got = []
    for frame in (df, df.repartition(7), df.orderBy(F.desc("doc_id")).coalesce(1)):
        net = masked_lm.train(frame)
        got.append({r["doc_id"]: r["log_prob"] for r in masked_lm.score(df, net).collect()})
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", SCORES.format(root=root)], capture_output=True, text=True, timeout=240,
                         env=os.environ | {"PYTHONPATH": root})
    got.append({int(x.split()[1]): float(x.split()[2]) for x in out.stdout.splitlines() if x.startswith("SCORE")})
    for other in got[1:]:
        assert other == pytest.approx(got[0], rel=1e-6), out.stderr[-1000:]


def test_learners_grow_with_the_corpus_alone():
    n = [masked_lm.learners_for(w) for w in (0, 10**6, 10**8, 10**10, 10**13)]
    assert n[:2] == [1, 1] and n == sorted(n) and 10**13 / n[-1] < 2 * 10**8


def test_toxicity_sample_loses_copies_alone(spark):
    rng = random.Random(6)
    word = lambda c, i: c + "".join(chr(97 + int(x)) for x in str(i))
    base = [word("v", i) for i in range(300)]
    texts = {i: " ".join(["the", *rng.sample(base, 8)]) for i in range(200)}  # a common least word
    long = [word("n", i) for i in range(58)]
    texts |= {300 + i: " ".join([*long, word("x", i)]) for i in range(30)}  # near copies
    texts |= {400: "Same  text here", 401: "same text HERE", 402: "same text there", 500: "", 501: "!!"}
    data = [(i, t, i % 2) for i, t in texts.items()] + [(150, texts[150], 0)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "__id long, __text string, __y int").repartition(3)
    scratch = toxicity.Scratch(spark, "test")
    kept = sorted(r["__id"] for r in toxicity.without_copies(df, scratch).collect())
    assert kept == [*range(200), 300, 400, 402, 500, 501]


def test_grouped_sums_and_places_are_those_of_the_plain_way():
    """Bit for bit, so that the trained weights do not move."""
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((500, 24)).astype(np.float32)
    for n in (1, 40, 3000):
        keys = np.sort(np.minimum(rng.zipf(1.3, n), 300))
        first, cell = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), rng.integers(3, 497, n)
        want = np.add.reduceat(np.take(rows, cell - 2, axis=0), first, axis=0)
        assert masked_lm._Sums(first, cell).of(rows, 2).tobytes() == want.tobytes()
    for size in (300, 1 << 17):  # linear sort, general sort
        keys = rng.integers(0, size, 5000)
        assert (masked_lm._order(keys, size) == np.argsort(keys, kind="stable")).all()
    ids = masked_lm._Ids([b"a", b"b"], 3)
    for words in ([], [b"b", b"x", b"a", b"yy", b"x"]):
        places, rare = ids.of(words)
        assert places.tolist() == [ids[w] for w in words] and rare == [w for w in words if w not in (b"a", b"b")]


def test_words_are_split_once_and_looked_up_once_each(monkeypatch):
    texts = [b"A_b-c\td9 b", None, b"", b" b b  b! ", "x\x00\u00c9\u4e2d b".encode(), b"...", b"b" * 5000]
    each = [words_of(t) for t in texts]
    words, which, sizes = masked_lm._distinct(texts)
    assert sizes.tolist() == [len(e) for e in each]
    assert [words[i] for i in which.tolist()] == [w for e in each for w in e] and len(set(words)) == len(words)
    for empty in ([], [None, b"", b"  "]):
        words, which, sizes = masked_lm._distinct(empty)
        assert words == [] and len(which) == 0 and sizes.tolist() == [0] * len(empty)
    asked, of = [], masked_lm._Ids.of
    monkeypatch.setattr(masked_lm._Ids, "of", lambda self, w: asked.extend(w) or of(self, w))
    net = tiny_network()
    ids, sizes = net.encode(texts)
    assert sorted(asked) == sorted({w for e in each for w in e})
    assert ids[masked_lm._places(sizes)[0]].tolist() == [net.ids[w] for e in each for w in e]


def test_counts_are_those_of_all_words(monkeypatch):
    texts = [f"w{i % 7} W{i % 90} x" for i in range(300)] + [None, "", "!"]
    batches = [pa.record_batch({"__text": pa.array(texts[i:i + 50], pa.string())}) for i in range(0, len(texts), 50)]
    want = Counter(w for t in texts for w in words_of((t or "").encode()))
    for held in (400_000, 120, 3):
        monkeypatch.setattr(masked_lm, "HELD_WORDS", held)
        got = Counter()
        for b in masked_lm._count(iter(batches)):
            assert b.schema.names == ["word", "n"] and b.schema.types == [pa.binary(), pa.int64()]
            got.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist())) if b.num_rows else {})
        assert got == want


def test_scores_and_steps_do_not_depend_on_blocks(monkeypatch):
    """Blocks are for the cache: all but the rounding stays."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 5000)).encode() for n in (900, 0, 1, 40, 700)]
    n = rng.integers(1, 50, masked_lm.VOCAB).astype(float)
    got = []
    for near in (1 << 16, 3000):
        monkeypatch.setattr(masked_lm, "NEAR", near)
        net = masked_lm.Network([f"w{i}".encode() for i in range(1, 1500)], n)
        ids, sizes = net.encode(texts)
        at, memory = masked_lm._places(sizes)[0], net.fresh_memory()
        for i in (0, 800):
            net.learn(ids, at[i:i + 800], memory)
        got.append((net, net.log_probs(ids, at)))
    (net, scores), (other, others) = got
    assert all(np.allclose(net.w[k], other.w[k], atol=1e-5) for k in net.w) and np.allclose(scores, others, atol=1e-4)
    assert np.allclose(scores, [plain_log_prob(net, ids.tolist(), i) for i in at.tolist()], atol=1e-3)


def test_softmax_is_cut_at_sixty():
    """As the plain formula, with the constants in the last row of the table."""
    rng = np.random.default_rng(2)
    h = np.ones((700, 5), dtype=np.float32)
    h[:, :4] = rng.standard_normal((700, 4))
    to = rng.standard_normal((5, 128)).astype(np.float32) * 3
    for scale in (1, 40, 400):
        z = np.minimum(h.astype(float) @ (to * np.float32(scale)), 60)
        want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        got = masked_lm._odds(h, to * np.float32(scale))
        assert np.isfinite(got).all() and np.allclose(got, want, atol=2e-3)
