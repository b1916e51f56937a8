"""Tables in a folder of parquet files, and the two degenerate sources."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def one_row(spark: SparkSession, schema: T.StructType | str, row: Sequence[Any]) -> DataFrame:
    return spark.createDataFrame([tuple(row)], schema)
