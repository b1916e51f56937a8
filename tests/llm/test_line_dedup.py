import random

import pytest

from millrace.llm import line_dedup
from millrace.llm.line_dedup import dedup_lines


def within_one(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i + 1 :] == y[i + 1 :] or x[i:] == y[i + 1 :] or x[i + 1 :] == y[i:]


def brute(docs):
    """Keys differ or their lines do."""
    want, seen = [], []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line:
                want.append((d, n, line, not any(within_one(line, s) for s in seen)))
                seen.append(line)
    return sorted(want, key=str)


def run(spark, docs, **how):
    got = dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), **how).collect()
    return sorted(map(tuple, got), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    docs = [(i, "\n".join("".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 7))) for _ in range(4))) for i in range(60)]
    long = ["".join(rnd.choice("abc é\U0001f600") for _ in range(rnd.randrange(20, 90))) for _ in range(12)]
    for i in range(60, 140):
        w = rnd.choice(long)
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1)
            w = w[:at] + rnd.choice(["", "x", "é"]) + w[at + rnd.randrange(2) :]
        docs.append((i, w + "\r\n" * rnd.randrange(2) + w[:3]))
    rnd.shuffle(docs)
    return docs + [(150, None), (151, ""), (152, "same line\nsame line\nsame lime"), (None, "a line without a key\n\nab"), (None, None)]


@pytest.mark.parametrize("seed,bits", [(1, 63), (2, 63), (3, 6)])
def test_against_brute_force(spark, seed, bits):
    """Keys of 6 bits make pairs fail, which are then joined by their text."""
    docs = corpus(seed)
    assert run(spark, docs, bits=bits) == brute(docs)


def test_repeated_rows_and_keys(spark):
    got = run(spark, [(1, "one line"), (1, "one line"), (1, "another text"), (1, "another tent"), (None, "null key"), (None, "null key")])
    assert [x for *_, x in got].count(True) == 3 and len(got) == 6
    assert sorted(line[:5] for _, _, line, kept in got if kept) == ["anoth", "null ", "one l"]


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    names = ("_id", "_line", "kept", "line_no", "o", "k", "v", "tag")
    frame = spark.createDataFrame([(2, "ab\nxyz", *["q"] * 8), (1, "abc", *["q"] * 8)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = sorted(map(tuple, dedup_lines(frame).collect()))
    assert got == [(1, 0, "abc", True), (2, 0, "ab", False), (2, 1, "xyz", True)]
    other = frame.selectExpr("cast(doc_id as string) as name", "text as body", "doc_id as text")
    assert sorted(r.name for r in dedup_lines(other, "name", "body").where("kept").collect()) == ["1", "2"]


def test_long_lines(spark):
    line = "".join(random.Random(4).choice("abcdefgh ") for _ in range(1_000_000))
    docs = [(1, line), (2, line[:700_000] + "é" + line[700_001:]), (3, line[:300_000] + line[300_001:]), (4, line[:10] + "éé" + line[10:])]
    assert [r[3] for r in run(spark, docs)] == [True, False, False, True]


def test_a_hot_key_makes_no_pairs(spark):
    """6,000 lines of one character, all within one edit: each meets the earliest alone."""
    docs = [(i, chr(0x4E00 + i)) for i in range(6000)]
    got = run(spark, docs)
    assert sum(r[3] for r in got) == 1 and len(got) == 6000


def test_variants_of_a_pair_meet():
    rnd = random.Random(5)
    for _ in range(300):
        x = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 12)))
        at = rnd.randrange(len(x) + 1)
        y = x[:at] + rnd.choice(["a", "b", ""]) + x[at + rnd.randrange(2) :]
        if not y or x == y or not within_one(x, y):
            continue
        assert line_dedup.within_one(x, y)
        line, tag, key = line_dedup.block_keys([x, y], 63)
        a, b = ({int(k): int(t) for k, t, i in zip(key, tag, line, strict=True) if i == n} for n in (0, 1))
        shared = set(a) & set(b)
        assert shared
        u, v = (line_dedup.variant_keys(s, sorted({m[k] for k in shared}), 63) for s, m in ((x, a), (y, b)))
        assert set(u[0].tolist()) & set(v[0].tolist())
