"""A one-hash Bloom filter of a long column: a fixed-size bitmap that decides which rows can have a partner at all.

It lets rows through that have none (about 1 in 16), never the other way, so that an exact join of what is left stays
right at every size. Its words are combined by the executors; the driver gets the bits, never the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 27  # 16 MB


class Sieve:
    def __init__(self, keys: DataFrame, column: str) -> None:
        """``column``: a bigint, hashed first. NULL is not entered."""
        n = keys.count()
        self.bits = min(MOST_BITS, max(10, (16 * n).bit_length()))
        at = F.pmod(F.xxhash64(column), F.lit(1 << self.bits))
        words = keys.where(F.col(column).isNotNull()).select(at.alias("a")).groupBy(F.shiftright("a", 6).alias("w"))
        got = words.agg(F.expr("bit_or(shiftleft(1L, cast(a % 64 as int)))").alias("bits")).toArrow()
        table = np.zeros(1 << (self.bits - 6), np.int64)
        table[got.column(0).to_numpy()] = got.column(1).to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(table)  # at most 16 MB

    def test(self, hashes: pa.Array) -> np.ndarray:
        """Which of these ``xxhash64`` values may be entered; for batch functions."""
        table, at = self.shared.value, hashes.to_numpy(zero_copy_only=False) & ((1 << self.bits) - 1)
        return ((table[at >> 6] >> (at & 63)) & 1).astype(bool)

    def passing(self, rows: DataFrame, column: str, keep: bool = True) -> DataFrame:
        """The rows whose ``column`` may be entered (``keep`` False: those whose column surely isn't; NULL isn't)."""
        columns = rows.columns

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                there = b.column(columns.index(column)).is_valid().to_numpy(zero_copy_only=False)
                hit = self.test(b.column(len(columns))) & there
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=columns).filter(pa.array(hit if keep else ~hit))

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.withColumn("_sieve", F.xxhash64(column)).mapInArrow(sift, ddl)
