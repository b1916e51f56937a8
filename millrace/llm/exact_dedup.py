"""Exact deduplication by composable polynomial fingerprints.

A text's normalised bytes are the digits of a number in base 256; its fingerprint is that number modulo a large prime.
Chunks are hashed on their own and combined by length-shifted arithmetic, fp(a + b) = fp(a) * 256^len(b) + fp(b), so that
a huge document is hashed in pieces. Rows of equal fingerprint and length are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.worker import trimmed
from millrace.operators.shared import settle

# Fixed value: a prime of 120 bits, so that residues fit 15 bytes and accidental equality is out of the question.
PRIME = (1 << 120) - 119
CHUNK = 1 << 16
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of [\\x20\\x09-\\x0D] as one space; NULL is empty."""
    if text is None:
        return b""
    out = text.encode("utf-8", "surrogatepass").translate(_SPACES)
    while b"  " in out:
        out = out.replace(b"        ", b" ").replace(b"  ", b" ")
    return out


def combine(left: int, right: int, right_length: int, prime: int = PRIME) -> int:
    """The fingerprint of two pieces on end."""
    return (left * pow(256, right_length, prime) + right) % prime


def fingerprint(data: bytes, prime: int = PRIME, chunk: int = CHUNK) -> int:
    if len(data) <= chunk:
        return int.from_bytes(data, "big") % prime
    shift, total = pow(256, chunk, prime), 0
    for at in range(0, len(data), chunk):
        piece = data[at : at + chunk]
        total = (total * (shift if len(piece) == chunk else pow(256, len(piece), prime)) + int.from_bytes(piece, "big")) % prime
    return total


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", prime: int = PRIME, chunk: int = CHUNK) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of ``docs``; other columns are ignored.

    Texts are equal when they are identical after each run of white space becomes one space. Of equal texts the row with
    the smallest key stays. NULL texts count as empty. A NULL key stands behind all others; of rows that repeat the
    smallest key one stays, so that every group keeps exactly one row. An empty table gives an empty result.

    Groups are counted with partial sums before the shuffle, and each task sends a repeated text on once, so a group of
    copies costs a task one row. Fingerprints that different texts share (chunks that differ) are told apart by their
    SHA-256.
    """

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, shas = [], [], []
            for t in batch.column(1):
                data = normalise(t.as_py())
                fps.append(fingerprint(data, prime, chunk).to_bytes(15, "big"))
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
            cols = [batch.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas)]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_fp", "_len", "_sha"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    hashed = rows.mapInArrow(trimmed(hash_rows), f"_id {kind}, _fp binary, _len bigint, _sha string")
    # a number, fixed by the write, tells rows of one key apart
    thin = settle(hashed.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = thin.groupBy("_fp", "_len").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first")).where("_n > 1")
    groups = settle(groups, "repeated")
    clash = _clashes(rows, groups, prime, chunk)
    if clash is not None:
        # different texts under one fingerprint: those rows are grouped by their digest instead
        bad = thin.join(clash, ["_fp", "_len"], "left_semi")
        split = bad.groupBy("_fp", "_len", "_sha").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
        good = groups.join(clash, ["_fp", "_len"], "left_anti").withColumn("_sha", F.lit(None).cast("string"))
        groups = good.unionByName(split)
        g = groups.withColumnRenamed("_sha", "_only").alias("g")
        same = (F.col("t._fp") == F.col("g._fp")) & (F.col("t._len") == F.col("g._len")) & F.coalesce(F.col("t._sha") == F.col("g._only"), F.lit(True))
        joined = thin.alias("t").join(g, same, "left").select("t.*", "g._n", "g._first")
    else:
        joined = thin.join(groups, ["_fp", "_len"], "left")
    stays = F.col("_first").isNull() | (F.col("_first.id").eqNullSafe(F.col("_id")) & (F.col("_first.row") == F.col("_row")))
    return joined.select(
        F.col("_id").alias(key),
        F.when(F.col("_first").isNull(), F.col("_id")).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
        stays.alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _sieve(groups: DataFrame, most_bits: int = 26) -> np.ndarray:
    """A one-hash Bloom filter of the groups' fingerprints: 16 bits for each, 2^most_bits at most (beyond that it lets
    more rows through, never fewer). Its words are combined by the executors; the driver gets only the bits."""
    n = groups.count()
    bits = min(most_bits, max(10, (16 * n).bit_length()))
    at = F.conv(F.hex(F.substring("_fp", 8, 8)), 16, 10).cast("decimal(20,0)") % (1 << bits)
    at = at.cast("bigint")
    words = groups.select(at.alias("a")).groupBy(F.shiftright("a", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(a % 64 as int)))").alias("bits"))
    got = words.toArrow()
    sieve = np.zeros(1 << (bits - 6), np.int64)
    sieve[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return sieve


def _clashes(rows: DataFrame, groups: DataFrame, prime: int, chunk: int) -> DataFrame | None:
    """(_fp, _len) of groups whose texts differ in some chunk, or None.

    Only rows that pass a Bloom filter of the repeated fingerprints take part. Of the texts of one fingerprint each task
    sends on one of each digest, cut into chunks; then all pieces of a chunk number are compared, with partial minima and
    maxima before the shuffle.
    """
    sieve = _sieve(groups)
    shared = rows.sparkSession.sparkContext.broadcast(sieve)  # at most 8 MB
    mask = len(sieve) * 64 - 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, {}
        for batch in batches:
            out: list[tuple[bytes, int, int, bytes]] = []
            for t in batch.column(0):
                data = normalise(t.as_py())
                fp = fingerprint(data, prime, chunk).to_bytes(15, "big")
                at = int.from_bytes(fp[7:], "big") & mask
                if not int(bits[at >> 6]) >> (at & 63) & 1:
                    continue
                digest = hashlib.blake2b(data, digest_size=16).digest()
                known = seen.setdefault((fp, len(data)), set())
                if digest not in known:
                    known.add(digest)
                    out += [(fp, len(data), i // chunk, data[i : i + chunk]) for i in range(0, max(1, len(data)), chunk)]
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_fp", "_len", "_no", "_piece"])

    cut = rows.select("_text").mapInArrow(trimmed(pieces), "_fp binary, _len bigint, _no bigint, _piece binary")
    cut = cut.join(groups.select("_fp", "_len"), ["_fp", "_len"], "left_semi")
    differ = cut.groupBy("_fp", "_len", "_no").agg(F.min("_piece").alias("a"), F.max("_piece").alias("b")).where("a <> b")
    differ = settle(differ.select("_fp", "_len").distinct(), "clashes")
    return differ if differ.take(1) else None
