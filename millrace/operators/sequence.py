"""Ordered sequences: numbering without a single-task window, slices, concatenation, append and prepend."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.shared import settle


Bound = int | Callable[[int], int]


def number_rows(df: DataFrame, ordinal: Sequence[str], name: str = "slot") -> DataFrame:
    """Each row's 0-based position in ordinal order.

    A range exchange sorts the rows, then a row's position is that within its range block plus the sizes of the blocks
    before it. The numbered blocks are written once, so that rows and sizes come from the same blocks; only the sizes
    (one row a partition) pass through one task. Ties are numbered in any order.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    within = Window.partitionBy("_block").orderBy(*ordinal)
    ranged = df.repartitionByRange(parts, *ordinal).withColumn("_block", F.spark_partition_id())
    numbered = settle(ranged.withColumn("_at", F.row_number().over(within).cast("bigint") - 1), "numbered")
    sizes = numbered.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    out = numbered.join(F.broadcast(before), "_block")
    return out.select((F.col("_before") + F.col("_at")).alias(name), *df.columns)


def ordered_slice(df: DataFrame, ordinal: Sequence[str], start: Bound, length: Bound) -> DataFrame:
    """(slot, columns) of the rows ``start`` to ``start + length - 1``; out-of-range parts are empty. Bounds may be
    functions of the number of rows.

    The sizes of the range blocks tell which of them the slice needs; only those are sorted and numbered.
    """
    if not ordinal:
        raise ValueError("a slice needs an ordinal")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = settle(df.repartitionByRange(parts, *ordinal).withColumn("_block", F.spark_partition_id()), "blocks")
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).orderBy("_block").collect()  # a row a partition
    total = sum(r["n"] for r in sizes)
    first, rows = (b(total) if callable(b) else b for b in (start, length))
    until, at, before = first + max(0, rows), 0, {}
    for r in sizes:
        if at < until and at + r["n"] > first:
            before[r["_block"]] = at
        at += r["n"]
    needed = blocks.where(F.col("_block").isin(list(before)))
    at_block = F.coalesce(*[F.when(F.col("_block") == b, F.lit(n)) for b, n in before.items()], F.lit(0)).cast("bigint")
    slot = at_block + F.row_number().over(Window.partitionBy("_block").orderBy(*ordinal)) - 1
    return needed.select(slot.cast("bigint").alias("slot"), *df.columns).where((F.col("slot") >= first) & (F.col("slot") < until))


def concat(left: DataFrame, right: DataFrame, idx: str = "idx") -> DataFrame:
    """``left`` then ``right``: the right side's positions move behind the left side's last. The offset is a one-row
    aggregate broadcast into the right side (a single row by construction)."""
    offset = left.agg((F.coalesce(F.max(idx), F.lit(-1)) + 1).alias("_offset"))
    moved = right.crossJoin(F.broadcast(offset)).withColumn(idx, F.col(idx) + F.col("_offset")).drop("_offset")
    return left.unionByName(moved.select(*left.columns))


def append(seq: DataFrame, element: DataFrame, idx: str = "idx") -> DataFrame:
    """``element``: a one-row frame with the value columns."""
    return concat(seq, element.withColumn(idx, F.lit(0).cast("bigint")).select(*seq.columns), idx)


def prepend(seq: DataFrame, element: DataFrame, idx: str = "idx") -> DataFrame:
    return concat(element.withColumn(idx, F.lit(0).cast("bigint")).select(*seq.columns), seq, idx)


def zip_with(left: DataFrame, right: DataFrame, idx: str = "idx") -> DataFrame:
    """Pairs by position; the longer side's rest is left out. Value columns must differ in name."""
    return left.join(right, idx)


def array_concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def array_split(items: Column, at: Column) -> tuple[Column, Column]:
    """An in-row sequence as its first ``at`` elements and the rest."""
    return F.slice(items, F.lit(1), at), F.slice(items, at + 1, F.greatest(F.size(items) - at, F.lit(0)))
