"""The coder in the executors' JVMs against mixcoder, and what the word encoder hands to the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import jvmcoder, mixcoder, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _segments():
    rng = np.random.default_rng(5)
    yield from (np.zeros(0, np.int64), np.array([7]), np.arange(6000) % 700, np.full(9000, 3))
    for n, top in [(4097, 5), (20000, 3000), (13000, 70000), (5000, (1 << 28) - 1)]:
        a = np.minimum(rng.zipf(1.2, n), top).astype(np.int64) if top < 1e8 else rng.integers(0, top, n)
        a[n // 3 : n // 2] = np.resize(a[:50], n // 2 - n // 3)
        yield a
    yield np.r_[np.arange(70000), rng.integers(0, 70000, 3 * mixcoder.BLOCK + 77)]


def _through(spark, coder, blobs):
    rows = coder(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, d binary"), "d").collect()
    return [bytes(r.d) for r in sorted(rows)]


def test_segments_are_those_of_mixcoder(spark):
    ids = list(_segments())
    raw, want = [a.astype("<u4").tobytes() for a in ids], [mixcoder.encode(a) for a in ids]
    got = _through(spark, jvmcoder.encoded, raw)
    for g, w, a in zip(got, want, ids, strict=True):  # but for the alphabet's table, which zlib may deflate in other ways
        (cut_g, cut_w) = (24 + int.from_bytes(x[20:24], "little") for x in (g, w))
        lanes = int.from_bytes(w[12:16], "little")
        assert g[:20] == w[:20] and g[cut_g : cut_g + 8 * lanes] == w[cut_w : cut_w + 8 * lanes] and g[cut_g + 8 * lanes + 4 :] == w[cut_w + 8 * lanes + 4 :]
        assert np.array_equal(mixcoder.decode(g), a)
    assert _through(spark, jvmcoder.decoded, want) == raw


@pytest.mark.parametrize("at", [0, 5, 25, 60, None, "cut"])
def test_damage_is_seen(spark, at):
    data = bytearray(mixcoder.encode(np.arange(6000) % 700))
    if at == "cut":
        data = data[:-2]
    else:
        data[len(data) // 2 if at is None else at] ^= 0x10
    with pytest.raises(Exception, match="corrupt segment"):
        _through(spark, jvmcoder.decoded, [data])


def _agrees(encoder, texts):
    flat, size = encoder.ids(texts)
    whole = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for t, w, e, n in zip(texts, whole, np.cumsum(size), size, strict=True):
        assert flat[e - n : e].tolist() == w, repr(t)


def test_words_are_cut_into_pieces_once(monkeypatch):
    """Signs and line ends around known words, and words that come again, cost no call of the library."""
    encoder = tokens.WordEncoder(PATH)
    _agrees(encoder, ["Haus, été. Haus\nété été!? 12a", " Haus , . ! ? \n"])
    learned = []
    monkeypatch.setattr(encoder, "_learn", lambda new, simple: learned.extend(new))
    encoder.ids(["Haus. Haus, Haus!? été, été\n été. Haus.\nété"])
    assert not learned


def test_cuts_keep_ids():
    """Every pair and many triples of characters of all classes, alone, after a word and before one."""
    some = list("aZé×÷ßſƀ5²½٣.,'#_<|\n\t \r\x1c\x00\x85 　日🙂ʼ’–…") + ["\n\n", "'s", "<|endoftext|>", "  ", "…", " "]
    rnd = random.Random(3)
    texts = [a + b for a in some for b in some] + ["".join(rnd.choices(some, k=rnd.randrange(3, 9))) for _ in range(3000)]
    texts += [f"word{t}end" for t in texts[:1500]] + [f"word {t} end" for t in texts[:1500]]
    encoder = tokens.WordEncoder(PATH)
    _agrees(encoder, texts)
    _agrees(encoder, texts[::-1])


def test_recurring_pieces_stay_in_memory(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMORY", 40)
    encoder = tokens.WordEncoder(PATH)
    for i in range(30):
        _agrees(encoder, ["often seen words", " ".join(f"x{'abcdefghij'[i % 10]}{'klm'[i // 10]}{chr(97 + j)}" for j in range(15))])
        assert len(encoder.known) <= 40 + 20
    assert {b" seen", b" words"} <= encoder.known.keys()
