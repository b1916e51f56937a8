import hashlib
import random
import re

import pytest

from millrace.llm import decontaminate as dc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, tests, width=8):
    windows = {}
    whole = [(str(i) if i is not None else "null", words(t)) for i, t in tests]
    for i, w in whole:
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, items, longest = words(t), set(), set(), 0
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    items |= got
                    hit |= set(range(k, k + n))
                    for _, v in whole:
                        for j in range(len(v)):
                            m = 0
                            while k + m < len(w) and j + m < len(v) and w[k + m] == v[j + m]:
                                m += 1
                            longest = max(longest, m)
        out.append((d, len(w), len(hit), sorted(items), longest))
    return sorted(out, key=str)


def run(spark, docs, tests, **how):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    t = spark.createDataFrame(tests, "item_id bigint, text string")
    got = dc.find_contamination(d, t, **how)
    rows = got.withColumn("n_hit", dc.hit_words()).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.longest) for r in rows], key=str)


def corpus(seed, n, vocab):
    rnd = random.Random(seed)
    text = lambda m: " ".join(rnd.choice(vocab) for _ in range(m))
    tests = [(i, text(rnd.choice([0, 3, 8, 12, 30]))) for i in range(12)] + [(3, text(20)), (None, text(9)), (40, None), (41, "Z z z z z z z z z z")]
    docs = []
    for i in range(n):
        parts = [text(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            t = (rnd.choice(tests)[1] or "").split(" ")
            a = rnd.randrange(len(t))
            parts += [", ".join(t[a : a + rnd.randrange(1, 25)]), text(rnd.randrange(5))]
        docs.append((i, "\n".join(parts)))
    return docs + [(None, "a"), (5, None), (5, ""), (77, "z " * 500), (78, "É é É")], tests


@pytest.mark.parametrize("seed,vocab", [(1, "a b c D"), (2, "alpha Beta gamma délta 42 x-y 日本 the of and"), (3, "a b")])
def test_against_brute_force(spark, seed, vocab):
    docs, tests = corpus(seed, 40, vocab.split())
    assert run(spark, docs, tests) == brute(docs, tests)


def test_slices_agree(spark, monkeypatch):
    docs, tests = corpus(4, 30, "a b c d e".split())
    want = [r[:4] for r in brute(docs, tests)]
    monkeypatch.setattr(dc, "SLICE_BYTES", 100)
    assert [r[:4] for r in run(spark, docs, tests)] == want


def test_pieces_of_a_huge_text():
    import numpy as np
    import pyarrow as pa

    texts = ["word" * 50 + " and more words " * 40, "", None, "x" * 300, "a b c"]
    data, off = dc.text_buffers(pa.array(texts))
    h, o = dc.word_hashes(data, off)
    for piece in (7, 64, 1000):
        h2, o2 = dc.word_hashes(data, off, piece)
        assert np.array_equal(h, h2) and np.array_equal(o, o2)
    assert len(h) == sum(len(words(t)) for t in texts)


def test_empty_tables_and_filter(spark):
    docs, tests = corpus(1, 10, "a b c".split())
    assert run(spark, [], tests) == []
    assert [r[2:] for r in run(spark, docs, [])] == [(0, [], 0)] * len(docs)
    d = spark.createDataFrame([(1, "x", "p q r s t u v w x", 5), (2, "y", "clean", 6)], "doc_id bigint, items string, text string, longest int")
    t = spark.createDataFrame([(1, "q r s t u v w x")], "item_id bigint, text string")
    got = dc.decontaminate(d, t)
    assert got.columns == d.columns and [tuple(r) for r in got.collect()] == [(2, "y", "clean", 6)]


def test_digest():
    assert dc.digest([]) == hashlib.sha256(b"").hexdigest()
