import random
import zlib

import numpy as np
import pytest

from millrace.llm import sharding as sh


def best_capacity(sizes, shards):
    """Least largest sum of ``shards`` contiguous runs, by dynamic programming."""
    total = np.r_[0, np.cumsum(sizes)]
    n = len(sizes)
    best = [total[i] for i in range(n + 1)]
    for _ in range(shards - 1):
        best = [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(n + 1)]
    return int(best[n])


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_the_minimax_capacity(seed):
    rnd = random.Random(seed)
    n, shards = rnd.randrange(1, 60), rnd.choice([1, 2, 5, 16])
    sizes = np.array([rnd.randrange(1, rnd.choice([5, 100, 2000])) for _ in range(n)])
    keys = np.array(sorted(rnd.sample(range(1 << 12), n)))

    def grouped(by, chosen=None):
        rows = {}
        for k, s in zip(keys, sizes):
            if chosen is None or (int(k) >> chosen[0]) in chosen[1]:
                p = int(k) >> by
                a, b = rows.get(p, (0, 0))
                rows[p] = (a + int(s), b + 1)
        return np.array([(p, a, b) for p, (a, b) in sorted(rows.items())], np.int64).reshape(-1, 3)

    def bins(m, by):
        return sh.Bins(m[:, 0], np.full(len(m), by), m[:, 1], m[:, 2])

    def refine(b, split):
        parts = []
        for i in range(len(b.size)):
            s = int(b.shift[i])
            if i in split:
                m = grouped(max(0, s - 2), (s, {int(b.prefix[i])}))
                parts.append(bins(m, max(0, s - 2)))
            else:
                parts.append(sh.Bins(b.prefix[i : i + 1], b.shift[i : i + 1], b.size[i : i + 1], b.groups[i : i + 1]))
        return sh.Bins(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("prefix", "shift", "size", "groups")])

    out, capacity, cuts = sh.search(bins(grouped(8), 8), shards, refine)
    assert capacity == best_capacity(sizes, shards)
    even = sh.even_cuts(out, shards, capacity, cuts)
    ends = np.r_[0, np.cumsum(out.size)]
    loads = np.diff(ends[np.r_[0, even]])
    assert even[-1] == len(out.size) and loads.max() <= capacity and len(even) <= shards


def shard(spark, docs, shards=16):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, shard string, size int")
    return sh.shard_documents(frame, shards).collect()


def check(docs, rows, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    of, texts = {}, dict()
    for d, t in docs:
        texts.setdefault(d, t)
    for r in rows:
        of.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in of.values())


def test_documents(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice("abcdé") * rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 40)))) for i in range(700)]
    docs += [(1000 + i, "copies of one text " * 30) for i in range(400)] + [(2000, None), (2001, ""), (None, "k"), (7, "again"), (7, "again"), (3000, "long " * 20000)]
    rows = shard(spark, docs)
    check(docs, rows, 16)
    by = {r.doc_id: r.shard for r in rows}
    assert len({by[1000 + i] for i in range(400)}) == 1 and by[2000] == by[2001]
    load = np.zeros(16)
    for r in rows:
        load[r.shard] += r.size
    copies, long = 400 * (len("copies of one text ") * 30 + 1), 100001
    rest = sorted(load)[:-2]
    assert sorted(load)[-1] == max(copies, load.max()) and max(rest) < 1.3 * min(rest) + 400 and long <= load.max()


def test_few_rows(spark):
    assert shard(spark, []) == []
    check([(1, "a")], shard(spark, [(1, "a")]), 16)
    docs = [(i, "same") for i in range(50)]
    rows = shard(spark, docs, 4)
    check(docs, rows, 4)
    assert {r.shard for r in rows} == {0}
