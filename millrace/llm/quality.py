"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over about thirty statistics of the whole text. Ridge regression needs only
the normal equations, which are sums over partitions; they are kept by fold, so that the driver gets the ridge constant
by cross-validation and out-of-fold scores for the calibration without fitting again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.decontaminate import pieces_of, text_buffers, word_hashes
from millrace.llm.sieve import Sieve
from millrace.llm.worker import trimmed
from millrace.operators.shared import settle

FOLDS, BINS = 3, 2000
_CLASSES = np.zeros((256, 12), bool)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 11, 12, 13), (10,), range(128, 192), range(192, 256), b".,;:", b"!?", b"|/\\_=~<>", b"#$%&*@^+", b"\"'()[]{}-`")):
    _CLASSES[list(_set), _i] = True
_KIND = np.where(_CLASSES.any(1), _CLASSES.argmax(1), 12).astype(np.uint8)
KINDS = 13


def statistics(column: pa.Array) -> np.ndarray:
    """A row of float32 statistics for each text; an empty or NULL text has only zeros."""
    n = len(column)
    data, off = text_buffers(column)
    start, size = off[:-1], np.diff(off)
    raw = data[off[0] : off[-1]]
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[raw]
    counts = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    letters = np.maximum(size - counts[:, 5], 1)  # code points
    share = counts / letters[:, None]
    space = (kind == 3) | (kind == 4)
    first = ~space
    first[1:] &= space[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    who = owner[at]
    words = np.bincount(who, minlength=n).astype(float)
    w = np.maximum(words, 1)
    ends = ~space
    ends[:-1] &= space[1:] | (owner[1:] != owner[:-1])
    stop = np.flatnonzero(ends)
    length = (stop - at + 1).astype(float)
    mean = np.bincount(who, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(who, length**2, n) / w - mean**2, 0))
    tail, head = kind[stop], kind[at]
    ending = np.stack([np.bincount(who, tail == k, n) / w for k in (7, 8, 9, 10)], 1)
    capital = np.bincount(who, head == 0, n) / w
    shout = np.bincount(who, (head == 0) & (kind[np.minimum(at + 1, len(kind) - 1)] == 0) & (length > 1), n) / w
    lines = counts[:, 4] + 1
    hashes, own = word_hashes(data, off)
    m = np.maximum(np.bincount(own, minlength=n), 1).astype(float)
    twice = np.zeros(len(hashes), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    echo = np.bincount(own, twice, n) / m
    key = np.sort((hashes & np.uint64((1 << 44) - 1)) | (own.astype(np.uint64) << np.uint64(44)))
    fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    whose = (key >> np.uint64(44)).astype(np.int64)
    kinds = np.bincount(whose, fresh, n)
    run = np.diff(np.r_[np.flatnonzero(fresh), len(key)])
    top = np.zeros(n)
    np.maximum.at(top, whose[fresh], run)
    out = np.column_stack([
        share, ending, np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, capital, shout, echo, kinds / m, top / m,
        np.log1p(words), np.log1p(size), np.log1p(lines), np.log1p(words / lines), np.log1p(kinds),
    ])
    out[size == 0] = 0
    return out.astype(np.float32)


WIDTH = KINDS + 4 + 12


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray  # of each fold's complement, then of all
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        d = self.project.shape[1]
        return np.column_stack([np.sqrt(2.0 / d) * np.cos(z @ self.project + self.phase), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights[-1]
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.999 * level + 0.001 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)  # ties of a level keep their order


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' centres and levels, ascending."""
    blocks: list[list[float]] = []
    for x, m, w in zip(at.tolist(), mean.tolist(), weight.tolist(), strict=True):
        blocks.append([x * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH)


def solve(gram: np.ndarray, right: np.ndarray, squares: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """From the folds' normal equations: ridge weights of each fold's complement and of all rows, the ridge constant
    being that of least cross-validated squared error."""
    eye = np.eye(gram.shape[1])
    eye[-1, -1] = 1e-9  # the constant is not shrunk
    best = (np.inf, None)
    for ridge in (1e-6, 1e-5, 1e-4, 1e-3, 1e-2):
        error, fits = 0.0, []
        for f in range(FOLDS):
            n = max(1, counts.sum() - counts[f])
            w = np.linalg.solve(gram.sum(0) - gram[f] + ridge * n * eye + 1e-9 * np.eye(len(eye)), right.sum(0) - right[f])
            error += w @ gram[f] @ w - 2 * w @ right[f] + squares[f]
            fits.append(w)
        if error < best[0]:
            whole = np.linalg.solve(gram.sum(0) + ridge * max(1, counts.sum()) * eye + 1e-9 * np.eye(len(eye)), right.sum(0))
            best = (error, np.array([*fits, whole]))
    return best[1]


def fit(labelled: DataFrame, dims: int = 256, width: float = 6.0, seed: int = 7, block: int = 64, tasks: int = 64) -> Model:
    """From (``_x`` binary statistics, ``_y`` 0 or 1, ``_fold``). All rows take part; what reaches the driver has a fixed
    size: moments a task, the normal equations a fold, and a histogram of scores. Without rows every score is 0.5."""
    rows = labelled.coalesce(tasks)
    sc = labelled.sparkSession.sparkContext

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for b in batches:
            x = _matrix(b.column(0)).astype(float)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()]), pa.array([q.tobytes()])], names=["n", "s", "q"])

    got = rows.select("_x").mapInArrow(moments, "n bigint, s binary, q binary").collect()
    n = sum(r["n"] for r in got)
    if not n:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.tile([0.0, 0.5], (FOLDS + 1, 1)), np.zeros(1), np.full(1, 0.5))
    mean = sum(np.frombuffer(r["s"]) for r in got) / n
    scale = np.sqrt(np.maximum(sum(np.frombuffer(r["q"]) for r in got) / n - mean**2, 1e-6))
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(size=(WIDTH, dims)) / width, rng.uniform(0, 2 * np.pi, dims), np.zeros((FOLDS + 1, dims + 1)), np.zeros(1), np.zeros(1))
    shared = sc.broadcast(model)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        d = dims + 1
        sums = np.zeros((FOLDS, d + 1, d))
        extra = np.zeros((FOLDS, 2))
        for b in batches:
            z, y, fold = model.features(_matrix(b.column(0))), b.column(1).to_numpy().astype(float), b.column(2).to_numpy()
            for f in range(FOLDS):
                zf, yf = z[fold == f], y[fold == f]
                sums[f, :d] += zf.T @ zf
                sums[f, d] += zf.T @ yf
                extra[f] += (yf @ yf, len(yf))
        keys = [(f, i) for f in range(FOLDS) for i in range(0, d + 1, block)]
        blobs = [sums[f, i : i + block].tobytes() for f, i in keys] + [extra[f].tobytes() for f in range(FOLDS)]
        keys += [(f, -1) for f in range(FOLDS)]
        cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["fold", "block", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p) for p in group.column("part").to_pylist())
        return pa.table([group.column("fold")[:1], group.column("block")[:1], pa.array([total.tobytes()])], names=["fold", "block", "part"])

    parts = rows.select("_x", "_y", "_fold").mapInArrow(normal, "fold int, block int, part binary")
    sums = {(r["fold"], r["block"]): np.frombuffer(r["part"]) for r in parts.groupBy("fold", "block").applyInArrow(add, "fold int, block int, part binary").collect()}
    d = dims + 1
    whole = np.array([np.concatenate([sums[f, i].reshape(-1, d) for i in range(0, d + 1, block)]) for f in range(FOLDS)])
    extra = np.array([sums[f, -1] for f in range(FOLDS)])
    model.weights = solve(whole[:, :d], whole[:, d], extra[:, 0], extra[:, 1])
    shared = sc.broadcast(model)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = shared.value, np.zeros((2, BINS))
        for b in batches:
            z, fold = model.features(_matrix(b.column(0))), b.column(2).to_numpy()
            raw = (z * model.weights[fold]).sum(1)
            np.add.at(n, (b.column(1).to_numpy(), np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()])], names=["n"])

    bins = sum(np.frombuffer(r["n"]) for r in rows.select("_x", "_y", "_fold").mapInArrow(histogram, "n binary").collect()).reshape(2, BINS)
    weight = bins.sum(0)
    full = weight > 0
    centre = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[full]
    model.knots, model.levels = isotonic(centre, bins[1][full] / weight[full], weight[full])
    return model


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def label_of(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(_k, _y): one label for each key, the greatest if there are several; NULL keys and labels are left out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(F.col(key).alias("_k")).agg(F.max((F.col(label) > 0).cast("int")).alias("_y"))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 3, remainder: int = 1, threshold: float = 0.5) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Learns from the labelled rows whose crc32(key as text) mod ``modulus`` is not ``remainder``; only the text is an input
    of a score. NULL and empty texts have all statistics 0 and get the score of that point. Rows of NULL key are scored
    and never learnt from. Rows that repeat a labelled key are all learnt from. Without labelled rows all scores are 0.5.
    Empty tables give an empty result.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = [r.tobytes() for _, piece in pieces_of(b.column(1)) for r in statistics(piece)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["_id", "_x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    measured = settle(rows.mapInArrow(trimmed(measure), f"_id {kind}, _x binary"), "statistics")
    out = held_out(F.col("_id"), modulus, remainder)
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int")
    known = measured.where(~out).join(label_of(labels, key, label), F.col("_id") == F.col("_k"))
    model = fit(settle(known.select("_x", "_y", fold.alias("_fold")), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["_id", "score"])

    scored = measured.mapInArrow(score, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(key), out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 3, remainder: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is ``threshold`` or more; the model is that of ``score_quality``.

    Only rows that may be labelled are measured for the fit; then every row is scored where it is read, so that no text
    is shuffled. Without labelled rows all scores are 0.5 and all rows stay for thresholds up to that.
    """
    known = settle(label_of(labels, key, label).where(~held_out(F.col("_k"), modulus, remainder)), "labels")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(key).alias("_h"))
    sieve = Sieve(known, "_k")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(sieve.test(b.column(2))))
            if b.num_rows:
                x = [r.tobytes() for _, piece in pieces_of(b.column(1)) for r in statistics(piece)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["_id", "_x"])

    measured = rows.mapInArrow(trimmed(measure), f"_id {kind}, _x binary")
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int")
    labelled = measured.join(known, F.col("_id") == F.col("_k")).select("_x", "_y", fold.alias("_fold"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(settle(labelled, "labelled")))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.concatenate([shared.value.score(statistics(piece)) for _, piece in pieces_of(b.column(at))])
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(trimmed(keep), docs.schema)
