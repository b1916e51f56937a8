"""Fused multi-verb pipelines: each is one projection-filter-aggregate stage in the physical plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.flow import Flow
from millrace.sources.ranges import Range


def multiples_sum(spark: SparkSession, n: int, a: int = 3, b: int = 5) -> DataFrame:
    """Sum of the numbers below ``n`` that ``a`` or ``b`` divides."""
    x = F.col("value")
    return Flow(Range(0, n).frame(spark)).filter((x % a == 0) | (x % b == 0)).reduce_df("sum", x, "total")


def nested_sum(spark: SparkSession, n: int, m: int) -> DataFrame:
    """For each x below n, y + 1 for y below m where its parity is x's; the sum of those that 3 divides.

    The inner sequence is an array literal in the row, so that the outer range is exploded without a join.
    """
    inner = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda y: y + 1)
    matching = F.filter(inner, lambda y: y % 2 == F.col("value") % 2)
    flat = Flow(Range(0, n).frame(spark)).flat_map(matching, "y")
    return flat.filter(F.col("y") % 3 == 0).sum_df(F.col("y"), "total")
