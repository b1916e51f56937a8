"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

n-grams (3 to 5 bytes of the lower-case words, with the word's edge as a character) are hashed into buckets. A bucket's
ratio is the log of its smoothed share of toxic documents over that of the others; the buckets of the greatest evidence
are kept, a document's features are the ratios of the buckets present, and logistic regression weighs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.decontaminate import _FOLD, pieces_of, text_buffers
from millrace.llm.quality import held_out, label_of
from millrace.llm.worker import trimmed
from millrace.operators.shared import settle

BITS, ORDERS = 20, (3, 4, 5)
BLOCK = 1 << 20  # pairs (row, column) that the fit works on at a time
PLACES = 1 << 16  # of the table by which repeated n-grams of a few texts are told
_MUL = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (bucket, text) of every n-gram of the texts."""
    data, off = text_buffers(column)
    raw = _FOLD[data[off[0] : off[-1]]]
    if not len(raw):
        return
    keep = raw != 0
    edge = np.zeros(len(raw), bool)
    edge[off[:-1][np.diff(off) > 0] - off[0]] = True
    # a word's edge: the byte after it, and a text's first byte is an edge of its own
    keep[1:] |= (raw[:-1] != 0) & ~edge[1:]
    at = np.flatnonzero(keep | edge)
    owner = (np.searchsorted(off, at + off[0], "right") - 1).astype(np.int32)
    stream = raw[at].astype(np.uint64)
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    # an edge before a text's first word and after its last
    tail = np.r_[head[1:], len(stream)]
    tail = tail[stream[tail - 1] != 0]
    owner = np.insert(owner, np.r_[tail, head], np.r_[owner[tail - 1], owner[head]])
    stream = np.insert(stream, np.r_[tail, head], 0)
    packed = stream.copy()
    for n in range(2, max(ORDERS) + 1):
        packed = (packed[:-1] << np.uint64(8)) | stream[n - 1 :]
        if n in ORDERS:
            h = (packed ^ np.uint64(n << 56)) * _MUL
            same = owner[: len(h)] == owner[n - 1 :]
            bucket = ((h ^ (h >> np.uint64(29))) * _MUL >> np.uint64(64 - BITS)).astype(np.int32)
            yield bucket[same], owner[: len(h)][same]


def present(column: pa.Array, slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs of the n-grams whose bucket has a slot (from 0 to ``slots`` - 1, else -1), by text.

    Of equal pairs the last writer of a place in a table of (text, slot) stays; the table holds a few texts at a time.
    """
    owners, found = [], []
    for bucket, owner in ngram_buckets(column):
        s = slot[bucket]
        hit = s >= 0
        owners.append(owner[hit])
        found.append(s[hit])
    few = max(1, PLACES // max(slots, 1))
    last = np.zeros(few * slots, np.int32)
    text, kept = [], []
    cuts = [np.searchsorted(o, np.arange(0, len(column) + few, few)) for o in owners]
    for k in range(-(-len(column) // few)):
        o = np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(owners, cuts, strict=True)] or [np.zeros(0, np.int32)])
        s = np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(found, cuts, strict=True)] or [np.zeros(0, np.int32)])
        place, number = (o - k * few) * slots + s, np.arange(len(o), dtype=np.int32)
        last[place] = number
        own = last[place] == number
        o, s = o[own], s[own]
        sort = np.argsort((o - k * few).astype(np.uint16), kind="stable")  # few is 2^16 at most
        text.append(o[sort])
        kept.append(s[sort])
    return (np.concatenate(text), np.concatenate(kept)) if text else (np.zeros(0, np.int32), np.zeros(0, np.int32))


class Matrix:
    """Row r has the value ``scale[c]`` in each column c of ``cols[ends[r]:ends[r + 1]]``; products both ways in blocks, so
    that besides the pairs (columns by row and rows by column, 2 bytes each where they fit) memory holds vectors."""

    def __init__(self, ends: np.ndarray, cols: np.ndarray, scale: np.ndarray) -> None:
        self.ends, self.cols, self.scale = ends, cols, scale
        n, width = len(ends) - 1, len(scale)
        self.rows = np.zeros(len(cols), np.min_scalar_type(max(n - 1, 0)))
        count = np.bincount(cols, minlength=width)
        self.tops = np.r_[0, np.cumsum(count)]
        room = self.tops[:-1].copy()
        for a, b in self._blocks(ends):
            c = cols[ends[a] : ends[b]]
            sort = np.argsort(c, kind="stable")
            n = np.bincount(c, minlength=width)
            at = np.arange(len(c)) + np.repeat(room - np.cumsum(n) + n, n)
            self.rows[at] = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))[sort]
            room += n

    @staticmethod
    def _blocks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of rows of about ``BLOCK`` pairs."""
        a = 0
        while a < len(ends) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK, "right")) - 1)
            yield a, b
            a = b

    @classmethod
    def _sums(cls, ends: np.ndarray, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ends) - 1)
        for a, b in cls._blocks(ends):
            start = ends[a:b] - ends[a]
            got = np.add.reduceat(np.r_[values[index[ends[a] : ends[b]]], 0.0], start)
            out[a:b] = np.where(ends[a + 1 : b + 1] > ends[a:b], got, 0.0)
        return out

    def ahead(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.ends, self.cols, self.scale * w)

    def back(self, v: np.ndarray) -> np.ndarray:
        return self.scale * self._sums(self.tops, self.rows, v)


def logistic(x: Matrix, y: np.ndarray, ridge: float = 1.0, gain: float = 1e-3, steps: int = 50) -> np.ndarray:
    """L2-penalised logistic regression (last weight: the constant, unpenalised) by Newton steps, each solved by conjugate
    gradients preconditioned with the diagonal, until a step promises less than ``gain`` of loss a row."""
    n, width = len(y), len(x.scale)
    penalty = np.r_[np.full(width, ridge), 1e-6]
    w, ahead, sign = np.zeros(width + 1), np.zeros(n), 2 * y - 1
    loss = lambda w, ahead: np.logaddexp(0, -sign * ahead).sum() + 0.5 * (penalty * w * w).sum()
    first = None
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ahead, -30, 30)))
        grad = np.r_[x.back(p - y), (p - y).sum()] + penalty * w
        curve = np.maximum(p * (1 - p), 1e-6)
        size = np.sqrt(grad @ grad)
        first = first or size
        if not size:
            break
        diagonal = np.r_[x.scale * x.back(curve), curve.sum()] + penalty
        step, moved, r = np.zeros_like(w), np.zeros(n), -grad
        z = r / diagonal
        d, rz = z.copy(), r @ z
        stop = (min(0.3, np.sqrt(size / first)) * size) ** 2
        for _ in range(60):
            ad = x.ahead(d[:-1]) + d[-1]
            hd = np.r_[x.back(curve * ad), (curve * ad).sum()] + penalty * d
            a = rz / (d @ hd)
            step += a * d
            moved += a * ad
            r -= a * hd
            if r @ r <= stop:
                break
            z = r / diagonal
            rz, old = r @ z, rz
            d = z + rz / old * d
        if -(grad @ step) / 2 <= gain * n:
            break
        far, now = 1.0, loss(w, ahead)
        while far > 1e-3 and loss(w + far * step, ahead + far * moved) > now:
            far /= 2
        w, ahead = w + far * step, ahead + far * moved
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, remainder: int = 2, threshold: float = 0.3, max_rows: int = 20_000, max_features: int = 32_768, least_documents: int = 3, seed: int = 11) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Learns from at most ``max_rows`` labelled rows (a hash sample; this bound keeps the fit on one machine) whose
    crc32(key as text) mod ``modulus`` is not ``remainder``; only the text is an input of a score. Rows that repeat a
    labelled key with another text are all learnt from, those that repeat the text too count once. A bucket counts from
    ``least_documents`` documents on; of those the ``max_features`` of greatest evidence weigh in a score (all n-grams of a
    text are looked up). NULL and empty texts have no n-grams and get the score of the constant; a text is held whole.
    Rows of NULL key are scored and never learnt from. Without labelled rows all scores are 0.5, with one class only its
    smoothed share. Empty tables give an empty result; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    out = held_out(F.col("_id"), modulus, remainder)
    known = label_of(labels, key, label).where(~held_out(F.col("_k"), modulus, remainder))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    named = rows.where(F.col("_id").isNotNull()).select("_id", "_hash").join(known, F.col("_id") == F.col("_k"))
    rank = F.pmod(F.xxhash64(F.lit(seed), "_k", "_hash"), F.lit(1 << 30))
    named = settle(named.select("_k", "_hash", "_y", rank.alias("_rank")).distinct(), "labelled")
    limit = 1 << 30
    while True:  # thin until within the bound; a second round only where hashes came out uneven
        sample = named.where(F.col("_rank") < limit)
        n = sample.count()
        if n <= max_rows:
            break
        limit = int(limit * min(0.98, 0.98 * max_rows / n))
    # at most max_rows pairs of key and text hash: small enough to send everywhere
    sample = F.broadcast(sample.select("_k", F.col("_hash").alias("_h"), "_y"))
    train = rows.join(sample, (F.col("_id") == F.col("_k")) & (F.col("_hash") == F.col("_h")))
    train = settle(train.dropDuplicates(["_k", "_h"]).select("_y", "_text"), "training")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, every = np.zeros((2, 1 << BITS), np.int32), np.arange(1 << BITS, dtype=np.int32)
        for b in batches:
            y = b.column(0).to_numpy()
            for at, piece in pieces_of(b.column(1)):
                text, bucket = present(piece, every, 1 << BITS)
                for k in (0, 1):
                    n[k] += np.bincount(bucket[y[at + text] == k], minlength=1 << BITS).astype(np.int32)
        found = np.flatnonzero(n.any(0))
        for i in range(0, len(found), 100_000):
            f = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(n[0, f]), pa.array(n[1, f])], names=["bucket", "n0", "n1"])

    n0, n1 = (int(v or 0) for v in train.agg(F.sum(1 - F.col("_y")), F.sum("_y")).first())
    slot, ratio = np.full(1 << BITS, -1, np.int64), np.zeros(0)
    if n0 and n1:
        counts = train.coalesce(16).mapInArrow(trimmed(frequencies), "bucket int, n0 int, n1 int").groupBy("bucket").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
        r = F.log(((F.col("b") + 1) / (n1 + 2)) / ((F.col("a") + 1) / (n0 + 2)))
        weighty = counts.where(F.col("a") + F.col("b") >= least_documents).select("bucket", r.alias("r"), (F.abs(r) * F.sqrt(F.col("a") + F.col("b"))).alias("e"))
        best = weighty.orderBy(F.desc("e"), "bucket").limit(max_features).toArrow()  # the features kept: at most max_features rows
        slot[best.column("bucket").to_numpy()] = np.arange(len(best))
        ratio = best.column("r").to_numpy()
    weights = np.zeros(len(ratio) + 1)
    slots = spark.sparkContext.broadcast(slot.astype(np.int32))  # 2^BITS numbers
    if len(ratio):
        kind_of = np.min_scalar_type(len(ratio) - 1)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = []
                for _, piece in pieces_of(b.column(1)):
                    text, s = present(piece, slots.value, len(ratio))
                    cuts = np.searchsorted(text, np.arange(len(piece) + 1))
                    parts += [s[i:j].astype(kind_of).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], names=["y", "slots"])

        got = train.mapInArrow(trimmed(vectors), "y int, slots binary").toArrow()
        lengths = pa.compute.binary_length(got.column("slots")).to_numpy() // kind_of.itemsize
        cols = np.concatenate([np.frombuffer(b"".join(c.to_pylist()), kind_of) for c in got.column("slots").chunks])
        y = got.column("y").to_numpy().astype(float)
        del got
        fitted = logistic(Matrix(np.r_[0, np.cumsum(lengths)], cols, ratio), y)
        weights = np.r_[fitted[:-1] * ratio, fitted[-1]]
    elif n0 + n1:
        weights[-1] = np.log((n1 + 1) / (n0 + 1))
    shared = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, slot = shared.value, slots.value
        for b in batches:
            s = np.zeros(b.num_rows)
            for at, piece in pieces_of(b.column(1)) if len(w) > 1 and b.num_rows else ():
                text, k = present(piece, slot, len(w) - 1)
                s[at : at + len(piece)] = np.bincount(text, w[k], len(piece))
            p = 1 / (1 + np.exp(-np.clip(s + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["_id", "score"])

    scored = rows.select("_id", "_text").mapInArrow(trimmed(score), f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(key), out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
