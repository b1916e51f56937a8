"""An arithmetic progression as a source, with closed forms for the aggregates that have one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """``start`` until ``end`` (exclusive) by ``step``; any step but 0. Sums are exact integers, never wrapped."""

    start: int
    end: int
    step: int = 1

    def __post_init__(self) -> None:
        if self.step == 0:
            raise ValueError("step must not be 0")

    @classmethod
    def inclusive(cls, start: int, last: int, step: int = 1) -> Range:
        return cls(start, last + (1 if step > 0 else -1), step)

    def __len__(self) -> int:
        return len(range(self.start, self.end, self.step))

    def frame(self, spark: SparkSession, name: str = "value", partitions: int | None = None) -> DataFrame:
        """Rows (idx, value): the position in the progression and the element; generated inside the scan."""
        ids = spark.range(0, len(self), 1, partitions) if partitions else spark.range(len(self))
        return ids.select(F.col("id").alias("idx"), (F.lit(self.start) + F.col("id") * F.lit(self.step)).alias(name))

    def sum(self) -> int:
        n = len(self)
        return n * self.start + self.step * (n * (n - 1) // 2)

    def min(self) -> int | None:
        n = len(self)
        return None if n == 0 else min(self.start, self.start + (n - 1) * self.step)

    def max(self) -> int | None:
        n = len(self)
        return None if n == 0 else max(self.start, self.start + (n - 1) * self.step)
