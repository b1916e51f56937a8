import random
import re

import pytest

from millrace.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def linked(docs, width, percent):
    """Each row's set and the number of its component."""
    sets = []
    for _, t in docs:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(docs))]


def brute(docs, width=3, percent=90):
    sets, root = linked(docs, width, percent)
    least = {}
    for (d, _), r in zip(docs, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(r) if s else d) for (d, _), s, r in zip(docs, sets, root, strict=True)), key=str)


def run(spark, docs, **how):
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), **how)
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str)


def corpus(seed, bases, copies, edits, length):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rnd.choice(vocab) for _ in range(25))
    docs = []
    for _ in range(bases):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(*length))]
        if rnd.random() < 0.4:
            w += passage.split()
        docs.append(" ".join(w))
        for _ in range(rnd.randrange(copies)):
            v = list(w)
            for _ in range(rnd.randrange(edits)):
                v[rnd.randrange(len(v))] = rnd.choice(vocab).upper()
            docs.append((" " if rnd.random() < 0.5 else "\n").join(v))
    rnd.shuffle(docs)
    out = list(enumerate(docs))
    return out + [(9000, None), (9001, ""), (9002, " \t"), (9003, "One"), (9004, "one"), (9005, "one two"), (9006, "two one"), (None, docs[0]), (None, "lonely words without a key"), (5, docs[7]), (3, docs[3]), (9100, "a b " * 400), (9101, "b a " * 700)]


@pytest.mark.parametrize("seed,bases,copies,edits,length", [(1, 30, 4, 4, (3, 90)), (2, 2, 60, 7, (100, 140)), (3, 40, 2, 2, (1, 12))])
def test_against_brute_force(spark, seed, bases, copies, edits, length):
    docs = corpus(seed, bases, copies, edits, length)
    assert run(spark, docs) == brute(docs)


def test_many_short_texts_in_one_partition(spark):
    rnd = random.Random(6)
    docs = []
    for i in range(1300):
        w = [f"w{rnd.randrange(3000)}" for _ in range(22)]
        docs += [(i, " ".join(w)), (5000 + i, " ".join(w + ["end"]))]
    rnd.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()], key=str)
    assert got == brute(docs) and sum(d != c for d, _, c in got) == 1300


def test_other_thresholds(spark):
    docs = corpus(4, 15, 5, 12, (20, 60))
    assert run(spark, docs, width=2, percent=70) == brute(docs, 2, 70)


def test_empty_table_and_survivors(spark):
    assert run(spark, []) == []
    docs = corpus(5, 12, 4, 3, (10, 60))
    frame = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(docs)], "doc_id bigint, text string, component_id int, h string")
    kept = jaccard.drop_near_copies(frame)
    assert kept.columns == frame.columns
    # a row of each component with its smallest key, and all rows without words: components, not smallest keys, count
    sets, root = linked(docs, 3, 90)
    groups = {}
    for (d, _), words, r in zip(docs, sets, root, strict=True):
        if words:
            groups.setdefault(r, []).append(d)
    want = [min((d for d in g if d is not None), default=None) for g in groups.values()]
    want += [d for (d, _), words in zip(docs, sets, strict=True) if not words]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_survivors_where_keys_repeat_or_are_null(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = [(None, a), (None, a + " more"), (None, b), (1, c), (1, d), (2, d + " more"), (None, c + " less"), (None, None), (None, "")]
    kept = jaccard.drop_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    got = sorted(((r.doc_id, (r.text or "")[:1]) for r in kept), key=str)
    assert got == sorted([(None, "a"), (None, "b"), (1, "c"), (1, "d"), (None, ""), (None, "")], key=str)
