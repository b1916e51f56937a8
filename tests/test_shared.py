import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators.shared import BATCH_BYTES, settle, settle_alone, shared_dir


def batch_sizes(rows):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    return rows.mapInArrow(sizes, "n bigint, bytes bigint")


def test_long_texts_come_in_small_batches(spark):
    shared_dir(spark)
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("ab "), 100_000).alias("text"))
    got = settle(batch_sizes(rows)).collect()
    assert sum(r.n for r in got) == 40 and max(r.bytes for r in got) <= BATCH_BYTES + 300_100
    one = spark.range(1).select(F.repeat(F.lit("ab "), 3_000_000).alias("text"))
    assert [r.n for r in batch_sizes(one).collect()] == [1]


def test_a_session_keeps_its_own_bound(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    shared_dir(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    try:
        shared_dir(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_spent_tables_are_deleted(spark):
    before = settle(spark.range(3), "before")
    made = []

    def make():
        made.append(settle(spark.range(5), "spent"))
        return made[0].where("id > 1")

    out = settle_alone(spark, make, "result")
    assert out.count() == 3 and before.count() == 3
    files = spark._jvm.org.apache.hadoop.fs.Path(made[0].inputFiles()[0])
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
