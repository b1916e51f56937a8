"""Token ids of documents in a compressed table of segments, and back.

Documents are range-sorted by key, encoded, and packed into segments of whole documents (``mixcoder``: independently
reset, checksummed blocks; ``jvmcoder`` codes them). A segment is a row of a parquet table in the shared folder: Spark's commit protocol makes a
lost or repeated task leave no trace, and any store that Spark writes will do. Columns: ``part`` and ``seg`` (the place of
the segment in the order), ``tokens`` (ids in it), ``before`` (ids before it in its part), ``keys`` and ``sizes`` (its
documents, with the end id), ``data``.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import jvmcoder
from millrace.llm.worker import release, trimmed
from millrace.operators.shared import register, shared_dir

SEGMENT = 4 << 20  # ids after which a segment is closed
_MEMORY = 400_000  # pieces whose ids a worker remembers
TOGETHER = 2000  # new pieces encoded as one text
_BLANK = np.zeros(256, bool)  # white space of one byte
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LETTER, _DIGIT, _SIGN, _LINE, _SPACE = 1, 2, 3, 4, 5  # classes of the bytes of simple words; others are 0
_JOINT = "\t"  # between simple pieces; no simple piece holds it


def _byte_classes(added: list[str]) -> np.ndarray:
    """Letters are ASCII's and U+00C0 to U+017F, by their bytes; an apostrophe may begin an English ending, which would be
    one piece with letters, and the first byte of an added token that token."""
    out = np.zeros(256, np.uint8)
    out[33:127] = _SIGN
    out[ord("0") : ord("9") + 1] = _DIGIT
    for first, last in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC5)):
        out[first : last + 1] = _LETTER
    out[10], out[32], out[ord("'")] = _LINE, _SPACE, 0
    out[[t.encode()[0] for t in added if t]] = 0
    if any(t.startswith(_JOINT) for t in added):
        out[:] = 0
    return out


def _letters(level: object) -> np.ndarray:
    """The letter that stands for each byte of simple words, as the library's byte level gives it."""
    out = np.zeros(256, "<u4")
    for char in [chr(i) for i in (*range(128), *range(0xC0, 0x180))]:
        (letters, _), = level.pre_tokenize_str(char)
        out[list(char.encode())] = [ord(c) for c in letters]
    out[ord(_JOINT)] = ord(_JOINT)
    return out


class _Memory(dict):
    """Piece to number; a piece not seen before gets the next number and is noted in ``new``."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all, and the bounds of each (int64)."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    strings = strings.cast(pa.large_binary())
    _, bounds, data = strings.buffers()
    bounds = np.frombuffer(bounds, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _word_bounds(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where words begin, and the end: each text's begin, and spaces before a character that isn't white space."""
    begin = np.zeros(len(data) + 1, bool)
    begin[texts] = True
    spaces = np.flatnonzero(data[:-1] == 32)
    spaces = spaces[~(_BLANK[data[spaces + 1]] | begin[spaces + 1])]
    long = np.isin(data[spaces + 1], (0xC2, 0xE1, 0xE2, 0xE3))  # may begin white space of two or three bytes
    if long.any():
        at = spaces[long]
        a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in (1, 2, 3))
        blank = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        blank |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF))) | (b == 0x81) & (c == 0x9F))
        long[long] = blank
        spaces = spaces[~long]
    begin[spaces] = True
    return np.flatnonzero(begin)


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``pool`` from each start, on end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and len(pool) < 1 << 31 else np.int64
    place = np.repeat((start - (ends - size)).astype(kind), size)
    place += np.arange(total, dtype=kind)
    return pool[place]


class WordEncoder:
    """Encodes texts piece by piece and remembers pieces.

    A byte-level tokenizer splits a text at white space before it merges anything: a space before a character that isn't
    white space always begins a new piece. So a text cut there has the ids of its words on end, and each distinct word of
    many texts is dealt with once. The tokenizer then splits where letters, digits and signs meet. Simple words, of the
    letters of ``_byte_classes``, digits, signs and single line ends, are cut there; other words are left whole. Pieces
    that come again are not encoded again. New ones are encoded many at a time and the ids told apart by the bytes they
    stand for: simple ones, with the byte level's letters for their bytes, by the same tokenizer split at a joint alone, words
    that begin with a space on end. Where ids
    don't end with the pieces (added tokens may reach over white space), and for other words, each is encoded as a small
    text. Tokenizers of other kinds encode whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        split = parts.get("pre_tokenizer") or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not parts.get("normalizer")
        self.bytes = np.zeros(0, np.int64)
        if self.by_word:
            added = {str(t) for t in (a["content"] for a in parts.get("added_tokens") or ())}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            for token, i in vocabulary.items():  # a letter stands for a byte
                self.bytes[i] = len(token.encode()) if token in added else len(token)
            self.classes = _byte_classes(sorted(added))
            self.joined = Tokenizer.from_file(path)
            self.joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_JOINT)
            self.letters = _letters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self.known = _Memory()
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0
        self.start, self.size, self.again = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def forget(self) -> None:
        """All but the half that came again most often."""
        pieces, again = list(self.known), self.again[: len(self.known)]
        often = np.flatnonzero(again)
        kept = np.sort(often[np.argsort(-again[often], kind="stable")[: _MEMORY // 2]])
        size = self.size[kept].astype(np.int64)
        ids = _gather(self.pool, self.start[kept].astype(np.int64), size)
        self.known = _Memory()
        self.known.update((pieces[i], k) for k, i in enumerate(kept.tolist()))
        self.used = 0
        self.again[: len(kept)] = again[kept] >> 1
        self.again[len(kept) :] = 0
        self._keep(np.arange(len(kept)), ids, np.cumsum(size))

    def ids(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the number of each text's."""
        if not self.by_word:
            got = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist() if isinstance(texts, pa.Array) else texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)
        if len(self.known) > _MEMORY:
            self.forget()
        data, edges = _buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(edges) - 1, np.int64)
        bounds = _word_bounds(data, edges)
        words = _strings(data, bounds).dictionary_encode()
        pool, start, size = self._words(words.dictionary)
        which = words.indices.to_numpy()
        size = size[which]
        ends = np.r_[0, np.cumsum(size)]
        return _gather(pool, start[which], size), np.diff(ends[np.searchsorted(bounds, edges)])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words on end, where each word's begin, and how many they are."""
        data, edges = _buffers(words)
        bounds, simple = self._piece_bounds(data, edges)
        first = np.searchsorted(bounds, edges)
        pieces = _strings(data, bounds).dictionary_encode()
        which, keys = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        if self.known.new:
            plain = np.zeros(len(keys), bool)
            plain[which] = np.repeat(simple, np.diff(first))
            self._learn(self.known.new, plain[at >= before])
            self.known.new = []
        self.again[at[at < before]] += 1
        size = self.size[at].astype(np.int64)[which]
        ends = np.r_[0, np.cumsum(size)][first]
        return _gather(self.pool, self.start[at].astype(np.int64)[which], size), ends[:-1], np.diff(ends)

    def _piece_bounds(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of words begin, and the end; and which words are simple."""
        begin = np.zeros(len(data) + 1, bool)
        begin[edges] = True
        kind = self.classes[data]
        here, back, inner = kind[1:], kind[:-1], ~begin[1:-1]
        odd = (here == _SPACE) | (here == _LINE) & ((back == _LINE) | (back == _SPACE))
        odd |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
        odd &= inner
        odd = np.r_[False, odd] | (kind == 0)
        simple = ~np.logical_or.reduceat(odd, edges[:-1])
        cut = (here != back) & (back != _SPACE) & inner
        if not simple.all():
            cut &= np.repeat(simple, np.diff(edges))[1:]
        begin[1:-1] |= cut
        return np.flatnonzero(begin), simple

    def _encode(self, texts: list[str], tokenizer: object = None) -> list:
        tokenizer = tokenizer or self.tokenizer
        return getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)(texts, add_special_tokens=False)

    def _learn(self, pieces: list[bytes], simple: np.ndarray) -> None:
        """Note the ids of ``pieces``, which have the last numbers."""
        n = len(self.known) - len(pieces)
        while len(self.known) > len(self.start):
            self.start, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.again))
        apart, after = [], []
        for i in np.flatnonzero(~simple).tolist():
            word = pieces[i].decode()
            (after if word[0] == " " and word[1:2].strip() else apart).append(i)
        for numbers, plain in ((np.flatnonzero(simple).tolist(), True), (after, False)):
            for at in range(0, len(numbers), TOGETHER):
                some = numbers[at : at + TOGETHER]
                if plain:
                    text = self.letters[np.frombuffer(_JOINT.encode().join([pieces[i] for i in some]), np.uint8)].tobytes().decode("utf-32-le")
                else:
                    text = b"".join([pieces[i] for i in some]).decode()
                ids = np.array(self._encode([text], self.joined if plain else self.tokenizer)[0].ids, np.int32)
                ends, reach = np.cumsum(np.fromiter((len(pieces[i]) for i in some), np.int64, len(some))), np.cumsum(self.bytes[ids])
                cut = np.searchsorted(reach, ends) + 1
                if not len(reach) or reach[-1] != ends[-1] or not np.array_equal(reach[cut - 1], ends):
                    apart += some
                    continue
                self._keep(n + np.array(some), ids, cut)
        for at in range(0, len(apart), 20_000):
            some = apart[at : at + 20_000]
            got = [e.ids for e in self._encode([pieces[i].decode() for i in some])]
            self._keep(n + np.array(some), np.array([t for x in got for t in x], np.int32), np.cumsum([len(x) for x in got]))

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """``ids`` of the pieces with these numbers on end, up to ``ends``."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = np.r_[0, ends[:-1]]
        self.start[numbers], self.size[numbers] = self.used + first, ends - first
        self.used += len(ids)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One for each worker process, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 2, segment: int = SEGMENT, chunk: int = 4 << 20) -> str:
    """Write every row of ``docs`` in ascending order of ``key`` (NULL first, rows of one key by a hash of their text) and
    return the folder. Without ``path`` it is one in the shared folder that goes with the session's other tables.

    ``tokenizer``: a file of the tokenizers library, at the same place on every machine. NULL texts are empty; every
    document gets ``end_id``. Other columns are ignored. An empty table gives a table without segments. A document is
    held whole in memory, as text and as ids; segments hold whole documents.
    """
    spark = docs.sparkSession
    if not path:
        path = f"{shared_dir(spark)}/millrace/tokens-{uuid.uuid4().hex}"
        register(spark, path)
    kind = docs.schema[key].dataType
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    # the hash splits a key that many rows repeat
    ordered = rows.repartitionByRange(parts, "_id", "_hash").sortWithinPartitions("_id", "_hash", "_text").select("_id", "_text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        keys, sizes, ids = [], [], []
        held, before, seg = 0, 0, 0

        def close() -> pa.RecordBatch:
            size, flat = np.concatenate(sizes), np.concatenate(ids)
            ids.clear()
            names = ["part", "seg", "tokens", "before", "keys", "sizes", "data"]
            whole = pa.concat_arrays(keys)
            cols = [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([before], pa.int64())]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.array(size))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([flat.astype("<u4", copy=False).tobytes()], pa.binary())], names=names)

        for batch in batches:
            lengths = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + chunk, "right")))
                flat, size = encoder.ids(batch.column(1).slice(at, stop - at))
                out = np.full(len(flat) + len(size), end_id, np.int32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(size + 1) - 1] = False
                out[keep] = flat
                keys.append(batch.column(0).slice(at, stop - at))
                sizes.append(size + 1)
                ids.append(out)
                held += len(out)
                at = stop
                if held >= segment:
                    yield close()
                    release()
                    before, seg, held = before + held, seg + 1, 0
                    keys, sizes, ids = [], [], []
        if held:
            yield close()

    ddl = f"part int, seg int, tokens bigint, before bigint, keys array<{kind.simpleString()}>, sizes array<bigint>, data binary"
    jvmcoder.encoded(ordered.mapInArrow(trimmed(pack), ddl), "data").write.option("compression", "none").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The segments, in any order; ``part`` and ``seg`` give their places."""
    return spark.read.parquet(path)


def documents_of(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document, decoded from the segments: the ids of all documents
    before it, its number of ids, the CRC-32 of its ids as little-endian u32, and those bytes. A segment whose checksums
    don't hold fails the task."""
    totals = segments.groupBy("part").agg(F.sum("tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))  # a row for each part
    placed = segments.join(F.broadcast(offsets), F.col("part") == F.col("_p"))
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(3)[i].as_buffer()
                size = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(size)
                view = memoryview(raw)
                cuts = list(zip((4 * (ends - size)).tolist(), (4 * ends).tolist(), strict=True))
                start = ends - size + b.column(0)[i].as_py()
                crc = np.array([zlib.crc32(view[x:y]) for x, y in cuts], np.int64)
                blob = pa.BinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int64).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([b.column(1)[i].values, pa.array(start), pa.array(size), pa.array(crc), blob.cast(pa.binary())], names=["_id", "start", "n_tokens", "ids_crc32", "ids"])

    inputs = placed.select((F.col("_offset") + F.col("before")).alias("from"), "keys", "sizes", "data")
    out = jvmcoder.decoded(inputs, "data").mapInArrow(trimmed(unpack), f"_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return out.select(F.col("_id").alias(key), "start", "n_tokens", "ids_crc32", "ids")
