"""The pipeline's stages on the smallest tables, each against its own input."""

import re

import pytest

import corpus_pipeline
from millrace.llm import mixing
from millrace.operators.shared import settle

DATA = "/root/testdata/sf0.001"
SHINGLE = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = settle(stage(spark, docs, DATA), name)
        out.append((docs, result))
        docs = result
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_columns_and_rows(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    texts = {r.doc_id: r.text for r in stages[0][0].collect()}
    for _, after in stages[:-1]:
        assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_quality_keeps_good_rows(spark, stages):
    kept = {r.doc_id for r in stages[0][1].collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good, bad = [r.doc_id in kept for r in labels if r.quality], [r.doc_id in kept for r in labels if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_near_copies(stages):
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in stages[1])
    sets = {}
    for d, t in before.items():
        w = SHINGLE.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(after) == {find(d) for d in ids} and len(after) < len(before)


def test_benchmark_passages(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = WINDOW.findall(lower(r.text))
        windows |= {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))}
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in stages[2])
    clean = set()
    for d, t in before.items():
        w = WINDOW.findall(lower(t))
        if not any(tuple(w[i : i + 8]) in windows for i in range(len(w))):
            clean.add(d)
    assert set(after) == clean


def test_mix_and_tokens(stages):
    before, after = stages[3]
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(before, whole=True).collect() if r.taken}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    rows = sorted(stages[4][1].collect(), key=lambda r: r.start)
    assert len(rows) == sum(got.values()) and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


NAMES = ("_copy", "copy", "_epochs", "_cut", "_of", "_k", "_g", "_r", "h", "s", "k", "score", "taken", "root", "component_id", "class_id", "_text", "_key", "spans", "items", "_id", "_class")


def odd(spark, rows):
    """Documents with columns whose names the stages use inside."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(d, t, None, s, None, *[f"{n} of {d}" for n in NAMES]) for d, t, s in rows], schema).repartition(3)


def plain_text(seed):
    import random

    rnd = random.Random(seed)
    syllables = "an be co du er fi go ha in jo ka lo mi no or pe ra si to un".split()
    return ". ".join(" ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 4))) for _ in range(9)).capitalize() for _ in range(5)) + "."


@pytest.mark.parametrize("number", range(4))
def test_stages_on_odd_rows(spark, number):
    """Each stage on NULLs in every column, empty and very long texts, ties, repeated rows and clashing names: all columns
    come back as they were, rows of one NULL or repeated key are told apart, and an empty table stays empty."""
    name, stage = corpus_pipeline.STAGES[number]
    long = " ".join(plain_text(i) for i in range(100, 500))
    rows = [(i, plain_text(i), "ab"[i % 2]) for i in range(12)]
    rows += [(None, plain_text(50), None), (None, plain_text(51), "a"), (3, plain_text(52), "b"), (5, plain_text(5), "b"), (5, plain_text(5), "b"), (20, None, "a"), (21, "", "b"), (22, " \n", None), (None, None, None), (23, long, "a")]
    docs = odd(spark, rows)
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[n] == f"{n} of {r.doc_id}" for r in got for n in NAMES)
    seen = [(r.doc_id, r.text) for r in got]
    assert set(seen) <= {(d, t) for d, t, _ in rows}
    if name in ("near_copies", "decontamination"):
        want = [(d, t) for d, t, _ in rows]
        if name == "near_copies":  # of the row that is there three times one stays
            want.remove((5, plain_text(5)))
            want.remove((5, plain_text(5)))
        assert sorted(seen, key=str) == sorted(want, key=str)
    if name == "mixing":
        assert all(t and t.strip() for _, t in seen) and {None, 3, 5} <= {d for d, _ in seen}
    assert stage(spark, docs.where("doc_id < -5"), DATA).collect() == []


def test_tokens_of_odd_rows(spark):
    rows = [(None, "null key", "a"), (None, None, None), (4, "twice", "a"), (4, "twice", "a"), (4, "other", "a"), (1, "", None), (2, "long " * 60_000, "b")]
    got = sorted(corpus_pipeline.STAGES[4][1](spark, odd(spark, rows), DATA).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 4, 4, 4] and [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(7)]
    assert corpus_pipeline.STAGES[4][1](spark, odd(spark, rows).where("doc_id < -5"), DATA).collect() == []


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
