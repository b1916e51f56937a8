import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import mixcoder, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50257) | st.integers(0, 3), max_size=400))
def test_round_trip(ids):
    a = np.array(ids, np.int64)
    assert np.array_equal(mixcoder.decode(mixcoder.encode(a)), a)


@pytest.mark.parametrize("n,top", [(4096, 50), (4097, 5), (8192, 50257), (9000, 1), (20000, 3000), (5000, (1 << 28) - 1), (13000, 70000)])
def test_round_trip_of_blocks(n, top):
    rng = np.random.default_rng(n)
    a = np.minimum(rng.zipf(1.2, n), top).astype(np.int64) if top < 1e8 else rng.integers(0, top, n)
    a[n // 3 : n // 2] = np.resize(a[:50], n // 2 - n // 3)
    data = mixcoder.encode(a)
    assert np.array_equal(mixcoder.decode(data), a)
    if top <= 50:
        assert len(data) < n


@pytest.mark.parametrize("kinds", [900, 5000, 70000])
def test_blocks_in_groups(monkeypatch, kinds):
    """A block's stream doesn't depend on the blocks coded beside it; ids beyond the prior's slots are escaped."""
    rng = np.random.default_rng(1)
    a = np.r_[np.arange(kinds), rng.integers(0, kinds, 3 * mixcoder.BLOCK + 77)]
    want = mixcoder.encode(a)
    monkeypatch.setattr(mixcoder, "PLACES", 2 * kinds)
    assert mixcoder.encode(a) == want and np.array_equal(mixcoder.decode(want), a)


def test_smaller_than_deflate():
    """The documents' ids, against deflated blocks of the same ids and against one deflated stream."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    a = tokens.WordEncoder(PATH).ids(texts)[0]
    raw, step = a.astype("<u2"), mixcoder.BLOCK
    size = len(mixcoder.encode(a))
    stream = len(zlib.compress(raw.tobytes(), 6))
    blocks = sum(len(zlib.compress(raw[i : i + step].tobytes(), 6)) for i in range(0, len(raw), step))
    print(f"bits an id: {8 * size / len(a):.2f}, deflate {8 * stream / len(a):.2f} as a stream, {8 * blocks / len(a):.2f} in blocks")
    assert size < stream and size < blocks


def test_damage_is_seen():
    data = bytearray(mixcoder.encode(np.arange(6000) % 700))
    for at in (0, 5, 25, 60, len(data) // 2):
        bad = bytearray(data)
        bad[at] ^= 0x10
        with pytest.raises(mixcoder.Corrupt):
            mixcoder.decode(bytes(bad))
    for cut in (data[:10], data[:-2], b""):
        with pytest.raises(mixcoder.Corrupt):
            mixcoder.decode(bytes(cut))


def test_words_have_the_ids_of_whole_texts():
    rnd = random.Random(1)
    pieces = ["word", "Ünï", "日本", "don't", "'s", "12", "!!", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "<|endoftext|>", "a.b", "ſ", "é", "\r\n", "'", " 's", "🙂"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    texts += ["", " ", "  ", "a ", " a", "a  b", "a \n b", "a\n  b ", "x" * 5000, "one two three", "b", "a \x00\x00b", "\x00b", "a b"]
    whole = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.WordEncoder(PATH)
    assert encoder.by_word
    for _ in range(2):
        flat, size = encoder.ids(texts)
        ends = np.cumsum(size)
        for t, w, e, n in zip(texts, whole, ends, size, strict=True):
            assert flat[e - n : e].tolist() == w, repr(t)
    assert not tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).by_word


def test_new_words_in_small_parts(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 3)
    monkeypatch.setattr(tokens, "_MEMORY", 20)
    test_words_have_the_ids_of_whole_texts()


@pytest.mark.parametrize("segment", [tokens.SEGMENT, 300])
def test_table_round_trip(spark, segment):
    rnd = random.Random(2)
    docs = [(i * 7 % 501, " ".join(rnd.choice(["alpha", "beta", "\nGamma", "δ"]) for _ in range(rnd.randrange(60)))) for i in range(300)]
    docs += [(None, "no key"), (9, None), (9, ""), (9, "twice"), (600, "long " * 9000)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, start int").repartition(5)
    path = tokens.write_tokens(frame, PATH, segment=segment, chunk=500)
    rows = tokens.documents_of(tokens.read_tokens(spark, path)).collect()
    rows.sort(key=lambda r: r.start)
    model = Tokenizer.from_file(PATH)
    # rows of one key stand by a hash of their text
    hashes = {r.text: r.h for r in frame.selectExpr("text", "xxhash64(coalesce(text, '')) as h").collect()}
    docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]], x[1] or ""))
    at = 0
    assert len(rows) == len(docs)
    for (d, t), r in zip(docs, rows, strict=True):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (d, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


def test_empty_table(spark):
    path = tokens.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH)
    assert tokens.documents_of(tokens.read_tokens(spark, path)).collect() == []
