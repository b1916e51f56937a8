import random

import pytest

from millrace.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, taken string"


def corpus(seed):
    rnd = random.Random(seed)
    docs = []
    for i in range(300):
        s = rnd.choice(["b", "b", "b", "b", "a", "ä", "z", None, "tiny"]) if i % 40 else "tiny"
        docs.append((i, rnd.choice([" ", "\n", " \t "]).join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 60))), s, "x"))
    return docs + [(900, None, "a", "x"), (901, "", "empty", "x"), (None, "one two", "a", "x"), (5, "again here", "b", "x"), (5, "again here", "b", "x"), (902, "\x0b\x1f  ", "b", "x"), (903, "w " * 3000, "z", "x")]


def words(t):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def dealt(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets in plain words: deal, hold what is above its cap, deal the rest again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight, size = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}, dict(order)
    held, open_ = {}, list(size)
    while open_:
        rest = share * sum(size.values()) - sum(held.values())
        given = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if given[s] > most * size[s]]
        if not over:
            return held | given
        held |= {s: float(most * size[s]) for s in over}
        open_ = [s for s in open_ if s not in held]
    return held


@pytest.mark.parametrize("whole", [False, True])
def test_targets_are_met(spark, whole):
    docs = corpus(1)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    rows = mixing.mix(frame, whole=whole, carry=True).collect()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), words(t)) for d, t, _, _ in docs)
    size, taken, target, most = {}, {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        most[r.source] = max(most.get(r.source, 0), r["size"])
        assert 0 <= r.taken <= 2 * r["size"] and (not whole or not r["size"] or r.taken % r["size"] == 0)
    for r in rows:
        assert r.source_size == size[r.source]
    want = dealt(list(size.items()))
    assert {s: round(v, 6) for s, v in want.items()} == {s: round(v, 6) for s, v in target.items()}
    for s in size:
        assert abs(taken[s] - int(target[s])) <= (most[s] / 2 if whole else 0)
    again = mixing.mix(frame.repartition(2), whole=whole, carry=True).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_targets_by_hand(spark):
    def given(rows, *weights):
        frame = spark.createDataFrame(rows, "_source string, source_size bigint")
        return {r._source: r.target for r in mixing.targets(frame, *weights).collect()}

    # 150% of 100; b gets 3/4 of it but at most 20, the rest goes to c and is held at 180
    assert given([("b", 10), ("c", 90)], (3, 1)) == {"b": 20.0, "c": 130.0} == dealt([("b", 10), ("c", 90)], (3, 1))
    assert given([]) == {}
    assert given([(None, 0)]) == {None: 0.0}
    got = given([("B", 100), ("a", 100), (None, 100)])
    assert got["B"] == 200.0 and abs(got["a"] - 250 / 3) < 1e-9 and abs(got[None] - 500 / 3) < 1e-9


@pytest.mark.parametrize("few", [1 << 20, 10])
def test_many_sources(spark, monkeypatch, few):
    """More sources than a broadcast takes are joined by exchanges, with the same result."""
    monkeypatch.setattr("millrace.llm.prefix.FEW", few)
    rnd = random.Random(7)
    docs = [(i, "w " * rnd.randrange(0, 9), rnd.choice(["hot", f"s{rnd.randrange(300)}"]), "x") for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(docs, SCHEMA), carry=True).collect()
    size, taken, target = {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = dealt(list(size.items()))
    assert len(want) > 250 and {s: round(v, 5) for s, v in want.items()} == {s: round(v, 5) for s, v in target.items()}
    assert all(taken[s] == int(target[s]) for s in size)


def test_columns_with_clashing_names(spark):
    docs = [d for d in corpus(3) if d[0] != 5]
    names = ("_copy", "copy", "_epochs", "epochs", "_cut", "cut", "s", "_0", "_s", "_of")
    plain = spark.createDataFrame(docs, SCHEMA)
    wide = spark.createDataFrame([(*d, *[f"{n}{d[0]}" for n in names]) for d in docs], SCHEMA + "".join(f", {n} string" for n in names))
    out = mixing.mix_rows(wide)
    assert out.columns == wide.columns
    got = out.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in mixing.mix_rows(plain).collect())


def test_rows_of_the_mix(spark):
    docs = [d for d in corpus(2) if d[0] != 5]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    want = {str(r.doc_id): r.taken // r["size"] for r in mixing.mix(frame, whole=True).collect() if r.taken}
    out = mixing.mix_rows(frame)
    assert out.columns == frame.columns
    got = {}
    texts = {str(d): t for d, t, _, _ in docs}
    for r in out.collect():
        got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + 1
        assert r.text == texts[str(r.doc_id)]
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mix_rows(empty).collect() == []
