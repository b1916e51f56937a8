import hashlib
import re

import pytest

from millrace.llm import exact_dedup as ed


def brute(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, (d, t) in enumerate(docs):
        groups.setdefault(norm(t), []).append((d is None, d or 0, i, d))
    rows = []
    for n, g in groups.items():
        keep = min(g)[3]
        rows += [(d, keep, len(g), hashlib.sha256(n.encode()).hexdigest()) for *_, d in g]
    return sorted(rows, key=str), len(groups)


def corpus():
    docs = [(i, f"text {i % 23}" + (" \n" if i % 3 else " ") + "end") for i in range(200)]
    return docs + [(300, None), (301, ""), (302, " "), (303, "\t\n"), (None, "text 1 end"), (None, None), (7, "text 7 end"), (7, "text 7 end"), (400, "é" * 70000), (401, "é" * 70000), (402, "é" * 69999 + "e"), (403, "only\x1fone")]


@pytest.mark.parametrize("prime,chunk", [(ed.PRIME, ed.CHUNK), (251, 64), (2, 1 << 16)])
def test_against_brute_force(spark, prime, chunk):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id bigint, text string, kept int, _fp string").repartition(4)
    rows = ed.dedup(frame, prime=prime, chunk=chunk).collect()
    want, groups = brute(docs)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=str) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == groups and len({r.text_sha256 for r in kept}) == groups
    assert all(str(r.doc_id) == str(r.keep_id) for r in kept)


def test_empty_table(spark):
    assert ed.dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_fingerprints_compose():
    data = bytes(range(256)) * 50
    whole = ed.fingerprint(data, chunk=1 << 20)
    assert whole == int.from_bytes(data, "big") % ed.PRIME
    for chunk in (1, 7, 1000):
        assert ed.fingerprint(data, chunk=chunk) == whole
    assert ed.combine(ed.fingerprint(data[:99]), ed.fingerprint(data[99:]), len(data) - 99) == whole
