import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality, toxicity

BAD = ["idiotic", "scumbag", "worthless"]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    syllables = "an be co du er fi go ha in jo ka lo mi no or pe ra si to un".split()
    docs, good, toxic = [], [], []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 80))]
        junk, rude = rnd.random() < 0.25, rnd.random() < 0.25
        if rude:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        if junk:
            words = [w + rnd.choice(["###", "$$$", "!!!"]) for w in words]
        docs.append((i, " ".join(words), "en", "s"))
        good.append((i, int(not junk), int(rude)))
    return docs, good


SCHEMA = "doc_id bigint, text string, lang string, score string"
LABELS = "doc_id bigint, quality int, toxic int"


def run(spark, docs, labels, which, **how):
    d = spark.createDataFrame(docs, SCHEMA).repartition(4)
    frame = spark.createDataFrame(labels, LABELS)
    return (quality.score_quality if which == "quality" else toxicity.score_toxicity)(d, frame, **how).collect()


@pytest.mark.parametrize("which,modulus,rest,cut", [("quality", 3, 1, 0.5), ("toxic", 4, 2, 0.3)])
def test_held_out_rows(spark, which, modulus, rest, cut):
    docs, labels = corpus(900)
    rows = run(spark, docs, labels, which)
    assert len(rows) == len(docs)
    truth = {i: (q if which == "quality" else t) for i, q, t in labels}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % modulus == rest}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # labels of held-out rows have no influence
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % modulus == rest else (i, q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in run(spark, docs, flipped, which)}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_odd_rows(spark, which):
    docs, labels = corpus(200, 2)
    docs += [(500, None, None, None), (501, "", "", ""), (None, "no key here", "en", "x"), (3, docs[3][1], "en", "x"), (502, "é" * 300000, "x", "x"), (503, "\x00\x01 \n", "x", "x"), (504, "a", "x", "x")]
    labels += [(None, 1, 1), (7, None, None), (7, 0, 1), (999, 1, 0), (500, 1, 0), (501, 0, 1)]
    rows = run(spark, docs, labels, which)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
    assert by[500][0].score == by[501][0].score and by[3][0].score == by[3][1].score
    assert by[None][0].held_out is False
    # without labels, without rows
    assert {r.score for r in run(spark, docs[:20], [], which)} == {0.5}
    assert run(spark, [], labels, which) == []
    one = run(spark, docs[:20], [(i, 1, 1) for i in range(20)], which)
    assert all(r.score > 0.5 for r in one)


def test_keep_good_agrees_with_scores(spark):
    docs, labels = corpus(300, 3)
    d, frame = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)
    kept = quality.keep_good(d, frame)
    assert kept.columns == d.columns
    want = {r.doc_id for r in quality.score_quality(d, frame).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want and len(want) > 150


def test_bounded_sample(spark):
    docs, labels = corpus(400, 4)
    rows = run(spark, docs, labels, "toxic", max_rows=150)
    truth = {i: t for i, _, t in labels}
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.85


def test_many_rare_toxic_words(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    common, own = [word() for _ in range(30)], [[word() for _ in range(400)] for _ in (0, 1)]
    docs, labels = [], []
    for i in range(6400):
        docs.append((i, " ".join([*rnd.choices(common, k=3), own[i % 2][i // 2 % 400]]), "en", "x"))
        labels.append((i, 1, i % 2))
    rows = run(spark, docs, labels, "toxic")
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.held_out]) > 0.97


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 0.5, 0.3, 0.3, 1, 0.9]), np.array([1, 1, 2, 1, 1, 3]))
    assert np.all(np.diff(y) > 0) and np.all(np.diff(x) > 0)
    assert abs(y[1] - (0.5 + 0.6 + 0.3) / 4) < 1e-12


def test_ngrams_against_strings():
    texts = ["Ab cd!", "", None, "x", "日本 go", "ab  CD"]
    seen = {}
    for bucket, owner in toxicity.ngram_buckets(pa.array(texts)):
        for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
            seen.setdefault(o, []).append(b)
    sizes = {k: len(v) for k, v in seen.items()}
    plain = {0: b"\0ab\0cd\0", 3: b"\0x\0", 4: "\0日本\0go\0".encode(), 5: b"\0ab\0cd\0"}
    assert sizes == {k: sum(max(0, len(s) - n + 1) for n in toxicity.ORDERS) for k, s in plain.items()}
    assert sorted(seen[0]) == sorted(seen[5])


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = (rng.random((200, 5)) < 0.4) * np.array([1.0, -2, 0.5, 3, 1])
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ np.array([1, 0.5, 0, -1, 0.2]))))).astype(float)
    r, c = np.nonzero(x)
    x_ = toxicity.Matrix(np.r_[0, np.cumsum(np.bincount(r, minlength=200))], c.astype(np.uint16), np.array([1.0, -2, 0.5, 3, 1]))
    w = toxicity.logistic(x_, y, gain=1e-9)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    grad = np.r_[x.T @ (p - y) + w[:-1], (p - y).sum() + 1e-6 * w[-1]]
    assert np.abs(grad).max() < 1e-2


def test_matrix_products(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 40)
    rng = np.random.default_rng(1)
    there = rng.random((70, 23)) < np.r_[0.0, np.linspace(0, 0.6, 69)][:, None]
    there[:, 5] = False
    scale = rng.normal(size=23)
    r, c = np.nonzero(there)
    m = toxicity.Matrix(np.r_[0, np.cumsum(there.sum(1))], c.astype(np.uint8), scale)
    w, v = rng.normal(size=23), rng.normal(size=70)
    assert np.allclose(m.ahead(w), (there * scale) @ w) and np.allclose(m.back(v), (there * scale).T @ v)


def test_distinct_ngrams_of_each_text(monkeypatch):
    monkeypatch.setattr(toxicity, "PLACES", 1000)
    rng = random.Random(3)
    texts = pa.array([None, "", *[" ".join(rng.choice(["abcab", "cab", "bé", "aaaaaa"]) for _ in range(rng.randrange(9))) for _ in range(50)]])
    slot = np.full(1 << toxicity.BITS, -1, np.int32)
    pairs = [(o, b) for bucket, owner in toxicity.ngram_buckets(texts) for b, o in zip(bucket.tolist(), owner.tolist(), strict=True)]
    some = sorted({b for _, b in pairs})[::2]
    slot[some] = np.arange(len(some))
    text, found = toxicity.present(texts, slot, len(some))
    assert (np.diff(text) >= 0).all()
    assert sorted(zip(text.tolist(), found.tolist(), strict=True)) == sorted({(o, int(slot[b])) for o, b in pairs if slot[b] >= 0})


def test_training_rows_are_bounded(spark, monkeypatch):
    """A labelled key may stand on any number of rows: the bound counts rows, and a repeated text once."""
    taken = []
    settled = toxicity.settle
    monkeypatch.setattr(toxicity, "settle", lambda df, name: (taken.append((name, settled(df, name))), taken[-1][1])[1])
    docs = [(1, f"bad words number {i % 90}", "en", "x") for i in range(600)] + [(i, "good words", "en", "x") for i in range(2, 30)] + [(None, None, "en", "x"), (40, None, "en", "x")]
    rows = run(spark, docs, [(1, 1, 1), *[(i, 1, 0) for i in range(2, 41)], (None, 1, 1)], "toxic", max_rows=50)
    n = dict((name, df.count()) for name, df in taken)["training"]
    assert 20 < n <= 50 and len(rows) == len(docs)
