"""Line deduplication by a deletion-neighbourhood join.

Lines within one edit become equal once a character is left out of both, or of the longer one. Such variants are emitted as
hashed keys, equal keys are joined, the pairs are verified by their edit distance, and of lines within one edit the earliest
stays.

Keys come coarse first. A line is cut into ``BLOCKS`` blocks; an edit lies in one of them, so two lines within one edit agree
once that block is left out of both, and only lines that share such a key with another line emit variants, for the characters
of that block alone. This loses no pair and spares the lines without a partner, nearly all, their key for each character.
Every key is joined with its earliest line only: lines that agree but for the character at one place are within one edit of
each other, and a line that is a variant of longer ones is within one edit of each. So a hot key costs a task one row, and no
pairs are made within a group.

Keys of all blocks and characters follow from running polynomial hashes, so that a line costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.decontaminate import pieces_of
from millrace.llm.sieve import Sieve
from millrace.llm.worker import trimmed
from millrace.operators.sequence import number_rows
from millrace.operators.shared import settle

BLOCKS = 4
SEEN = 1 << 20  # lines that a task remembers having sent
ROWS = 1 << 18  # keys of a batch
BASE, SHORT, LONG = 0, 1, 2  # a line that leaves a character out for an equally long one; whole; that leaves one out for a shorter one
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Polynomial hashes of what is left of lines (code points on end) when a stretch is cut out."""

    def __init__(self, points: np.ndarray) -> None:
        self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(points), b)]) for b in (_BASE, _BACK))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_stir(points.astype(np.uint64) + _A) * self.up[:-1], out=self.sums[1:])

    def without(self, start: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
        """Of the lines at [start, end) without [a, b)."""
        left = (self.sums[a] - self.sums[start]) * self.down[start]
        right = (self.sums[end] - self.sums[b]) * self.down[b - (a - start)]
        return _stir(_stir(left + right) + (end - b + a - start).astype(np.uint64) * _B) >> np.uint64(64 - bits)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edges(base: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin and end in lines of length ``base``."""
    return block * base // BLOCKS, (block + 1) * base // BLOCKS


def block_keys(lines: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, tag, key) of every line without each of its blocks. A line stands for itself (tags from 0) and, as the longer
    of a pair, for a line with one character less, a block then holding one more (tags from ``BLOCKS``)."""
    points = code_points("".join(lines))
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(n)
    hashes, out = Hashes(points), []
    for more in (0, 1):
        some = np.flatnonzero(n > more)
        for j in range(BLOCKS):
            lo, hi = edges(n[some] - more, np.full(len(some), j))
            start = (end - n)[some]
            key = hashes.without(start, start + lo, start + hi + more, end[some], 64)
            key = _stir(key + (n[some] - more).astype(np.uint64) * _A + np.uint64(j)) >> np.uint64(64 - bits)
            out.append((some, np.full(len(some), more * BLOCKS + j), key.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def variant_keys(line: str, tags: list[int], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, place) of a line's variants in the blocks of ``tags``: itself, and without the character at ``place``."""
    points, n = code_points(line), len(line)
    hashes, none = Hashes(points), np.zeros(1, np.int64)
    out = []
    if min(tags) < BLOCKS:
        whole = hashes.without(none, none, none, none + n, 64)
        out.append((_stir(whole + np.uint64(1)), np.full(1, SHORT), none - 1))
    for more, side in ((0, BASE), (1, LONG)):
        spans = [edges(np.int64(n - more), np.int64(t % BLOCKS)) for t in tags if t // BLOCKS == more]
        at = np.unique(np.concatenate([np.arange(a, b + more) for a, b in spans])) if spans else none[:0]
        if len(at):
            zero = np.zeros(len(at), np.int64)
            cut = hashes.without(zero, at, at + 1, zero + n, 64)
            # lines of one length must miss the same place, a longer line any
            out.append((_stir(cut + np.uint64(1)) if more else _stir(cut ^ (at.astype(np.uint64) * _A + np.uint64(2))), np.full(len(at), side), at))
    key, side, place = (np.concatenate(x) for x in zip(*out, strict=True))
    return (key >> np.uint64(64 - bits)).astype(np.int64), side, place


def within_one(x: str, y: str) -> bool:
    """Whether at most one character is put in, left out or exchanged."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    a, b = code_points(x), code_points(y)
    differ = np.flatnonzero(a != b[: len(a)])
    if not len(differ):
        return True
    at = int(differ[0])
    return bool(np.array_equal(a[at + (len(a) == len(b)) :], b[at + 1 :]))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 63) -> DataFrame:
    """(key, line_no, line, kept) for every line of ``docs`` that isn't empty; other columns are ignored.

    A line is kept unless it repeats an earlier line, or an earlier line is within one edit of it (one code point put in,
    left out or exchanged). Order is by (key, line number), NULL keys first; where keys repeat, by a hash of the line, and
    of rows that are alike in all of these one is the earliest, so that of repeated rows one stays. NULL and empty texts
    and an empty table have no lines. Lines end at a line feed alone. A text is held whole in memory and split into lines;
    a line, however long, costs time and memory in proportion to its length.

    Equal lines are told by 128-bit BLAKE2b digests. ``bits`` is the length of the other keys (at most 63): whatever equal
    hashes join is verified, and keys under which a pair fails are joined again by their text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, piece in pieces_of(b.column(1)):
                split = [(t or "").split("\n") for t in piece.to_pylist()]
                owner = [i for i, lines in enumerate(split) for x in lines if x]
                number = [k for lines in split for k, x in enumerate(lines) if x]
                whole = [x for lines in split for x in lines if x]
                digest = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in whole)
                h = np.frombuffer(digest, np.int64).reshape(-1, 2)
                cols = [b.column(0).take(pa.array(owner, pa.int64()) if not at else pa.array([at + i for i in owner], pa.int64())), pa.array(number, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(whole, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "_no", "_h", "_g", "_line"])

    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = rows.mapInArrow(trimmed(cut), f"_id {kind}, _no int, _h bigint, _g bigint, _line string")
    lines = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "lines")  # numbers fixed by the write
    first = F.min(F.struct("_id", "_no", "_h", "_g", "_row")).alias("_first")
    distinct = settle(lines.groupBy("_h", "_g").agg(first, F.count(F.lit(1)).alias("_n")), "distinct")
    dropped = _near_earlier(lines, distinct, bits)
    told = distinct.where("_n > 1").join(dropped, ["_h", "_g"], "full")
    told = settle(told.select("_h", "_g", F.col("_first._row").alias("_stays"), F.coalesce("_near", F.lit(False)).alias("_near")), "told")
    out = lines.join(told, ["_h", "_g"], "left")
    stays = F.coalesce(F.col("_stays") == F.col("_row"), F.lit(True)) & ~F.coalesce("_near", F.lit(False))
    return out.select(F.col("_id").alias(key), F.col("_no").alias("line_no"), F.col("_line").alias("line"), stays.alias("kept"))


def _near_earlier(lines: DataFrame, distinct: DataFrame, bits: int) -> DataFrame:
    """(_h, _g, _near) of the distinct lines within one edit of an earlier one."""
    hits = _block_hits(lines, bits)
    named = hits.select("_h", "_g").distinct().join(distinct.select("_h", "_g", "_first"), ["_h", "_g"])
    # a number in place of the order, for the lines that have a block's key in common
    order = number_rows(named.select("_first", "_h", "_g"), ["_first"], "o")
    order = settle(order.select("_h", "_g", "o"), "order")
    passed = Sieve(order, "_h").passing(lines.select("_h", "_g", "_line"), "_h")
    spelt = passed.dropDuplicates(["_h", "_g"]).join(order, ["_h", "_g"])
    texts = settle(spelt.select("o", F.col("_line").alias("x")), "texts")
    tags = hits.groupBy("_h", "_g").agg(F.collect_set("tag").alias("tags"))  # at most 2 * BLOCKS
    tagged = texts.join(tags.join(order, ["_h", "_g"]).select("o", "tags"), "o")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for o, line, tags in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                k, side, at = variant_keys(line, tags, bits)
                held.append((k, side.astype(np.int32), at.astype(np.int32), np.full(len(k), o)))
                n += len(k)
                if n >= ROWS:
                    yield from flush(held)
                    held, n = [], 0
            yield from flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["v", "side", "at", "o"])
            for i in range(0, whole.num_rows, ROWS):
                yield whole.slice(i, ROWS)

    keys = settle(tagged.select("o", "x", "tags").mapInArrow(trimmed(emit), "v bigint, side int, at int, o bigint"), "variants")
    good, bad = _verified(keys, texts, ["v"])
    if bad is not None:  # different texts under one hash: those keys by their text
        again = keys.join(bad, "v", "left_semi").join(texts, "o")
        body = F.concat(F.col("x").substr(F.lit(1), F.col("at")), F.col("x").substr(F.col("at") + 2, F.length("x")))
        again = again.select("v", "side", "at", "o", F.when(F.col("side") == SHORT, F.col("x")).otherwise(body).alias("body"), F.when(F.col("side") == BASE, F.col("at")).otherwise(-1).alias("place"))
        more, _ = _verified(settle(again, "spelt"), texts, ["body", "place"])
        good = good.union(more)
    return order.join(good.distinct(), "o").select("_h", "_g", F.lit(True).alias("_near"))


def _block_hits(lines: DataFrame, bits: int) -> DataFrame:
    """(_h, _g, tag) of the block keys that at least two distinct lines have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for at, piece in pieces_of(b.column(2)):
                h, g = (b.column(i).slice(at, len(piece)).to_numpy() for i in (0, 1))
                fresh = []
                for i, both in enumerate(zip(h.tolist(), g.tolist(), strict=True)):
                    if both not in seen:
                        seen.add(both)
                        fresh.append(i)
                if not fresh:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                line, tag, k = block_keys(piece.take(pa.array(fresh)).to_pylist(), bits)
                row = np.array(fresh)[line]
                yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(g[row]), pa.array(tag.astype(np.int32)), pa.array(k)], names=["_h", "_g", "tag", "k"])

    # computed twice: keys in common first, then, past a bitmap of them, the lines that have them
    keys = lines.select("_h", "_g", "_line").mapInArrow(trimmed(emit), "_h bigint, _g bigint, tag int, k bigint")
    common = keys.groupBy("k").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo <> hi").select("k")
    common = settle(common, "blocks")
    return settle(Sieve(common, "k").passing(keys, "k").join(common, "k", "left_semi").select("_h", "_g", "tag"), "hits")


def _verified(keys: DataFrame, texts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(o) of the lines that an earlier line under one of their keys is within one edit of; and the hashes under which a
    pair isn't, if any."""
    least = [F.min(F.when(F.col("side") == s, F.col("o"))).alias(n) for s, n in ((BASE, "even"), (SHORT, "whole"), (LONG, "longer"))]
    earliest = settle(keys.groupBy(*by).agg(*least, F.count(F.lit(1)).alias("n")).where("n > 1"), "earliest")
    partner = F.when(F.col("side") == BASE, F.col("even")).when(F.col("side") == SHORT, F.col("longer")).otherwise(F.col("whole"))
    met = keys.join(earliest.drop("n"), by).select("v", "o", partner.alias("p")).where("p < o")
    pairs = settle(met.groupBy("o", "p").agg(F.collect_set("v").alias("vs")), "pairs")
    spelt = pairs.join(texts, "o").join(texts.select(F.col("o").alias("p"), F.col("x").alias("y")), "p").select("o", "vs", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [within_one(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(near, pa.bool_())], names=["o", "vs", "near"])

    checked = settle(spelt.mapInArrow(trimmed(check), "o bigint, vs array<bigint>, near boolean"), "checked")
    bad = checked.where("not near").select(F.explode("vs").alias("v")).distinct()
    return checked.where("near").select("o"), bad if bad.take(1) else None
