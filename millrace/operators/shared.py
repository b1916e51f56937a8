"""Intermediate tables in the folder that driver and executors share: the cut of a long lineage.

A table written once and read again is fixed: what is computed from it twice agrees, and a lost executor costs a reread,
not a recomputation. The folder is ``spark.checkpoint.dir``; only where a local session has none, as in tests, a
temporary folder is set.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20  # of an Arrow batch; a longer row is a batch of its own
_written: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Python workers of this session get Arrow batches of ``BATCH_BYTES`` at most, unless it has a bound of its own. Spark's
    default is 64 MB, which a task holds outside of the heap, and its worker again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    bound_batches(spark)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    register(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """What ``make`` returns, settled; the tables written meanwhile are deleted. No other frame may read them."""
    first = len(_written)
    out = settle(make(), name)
    spent = _written[first:-1]
    del _written[first:-1]
    for owner, path in spent:
        _delete(owner, path)
    return out


def register(spark: SparkSession, path: str) -> None:
    """A folder that ``release`` is to delete."""
    _written.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete the registered folders, those that ``settle`` wrote among them; frames that read them must be done."""
    for owner, path in [w for w in _written if w[0] is spark]:
        _delete(owner, path)
        _written.remove((owner, path))


@atexit.register
def _tidy() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        with contextlib.suppress(Exception):
            release(spark)
