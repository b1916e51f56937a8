"""Distributed prefix sums: an order over all rows, positions and running totals, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.shared import settle


FEW = 200_000  # rows of a table that goes to every task; larger ones are joined by exchanges, which AQE splits where hot


def checked(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast in a join if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def running_sums(df: DataFrame, group: str, order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with the column ``name``: the sum of ``value`` (bigint, not NULL) over the rows of the same ``group`` that
    stand before the row in ``order``.

    One range exchange by (group, order) sorts the rows, so a hot group spreads over as many tasks as its rows need, if
    ``order`` tells its rows apart. Each task adds up its own rows; the tasks' totals (a row for each task and group it
    holds: at most tasks + groups) give the offsets. Groups are told apart by NULL too. Rows equal in ``order`` take
    their places in any order, fixed once the table is written.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = df.columns
    at, val = columns.index(group), columns.index(value)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried, seen = None, 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(at).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy(zero_copy_only=False)
            v = batch.column(val).to_numpy(zero_copy_only=False)
            total = np.cumsum(v)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            base = (total - v)[starts]
            base[0] = -carried if seen and codes.dictionary[int(code[0])].as_py() == last else 0
            out = (total - v) - np.repeat(base, np.diff(np.r_[starts, n]))
            last, carried, seen = codes.dictionary[int(code[-1])].as_py(), int(out[-1] + v[-1]), True
            arrays = [*batch.columns, pa.array(out, pa.int64()), pa.array(np.full(n, part, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "_within", "_part"])

    ranged = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    placed = settle(ranged.mapInArrow(add_up, f"{ddl}, _within bigint, _part int"), "placed")
    sums = placed.groupBy("_part", F.col(group).alias("_group")).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_part").alias("_p"), "_group", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    both = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))
    out = placed.join(checked(settle(offsets, "offsets")), both, "left")
    return out.select(*columns, (F.col("_within") + F.col("_offset")).alias(name))
