"""``mixcoder`` in the executors' JVMs: MixCoder.java, compiled by the driver with the compiler that Spark's own code
generation uses, and sent to the executors as a jar through Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_added: dict[str, tuple[object, object]] = {}


def _functions(spark: SparkSession) -> tuple[object, object]:
    """Encoder and decoder, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _added:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(resources.files("millrace.llm").joinpath("MixCoder.java").read_text())
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"mixcoder-{app}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(path)
        make = compiler.getClassLoader().loadClass("millrace.MixCoder").getConstructors()[0]
        _added[app] = tuple(make.newInstance(_array(spark, decoding)) for decoding in (False, True))
    return _added[app]


def _array(spark: SparkSession, value: object) -> object:
    out = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 1)
    out[0] = value
    return out


def _with(df: DataFrame, column: str, decoding: bool) -> DataFrame:
    spark = df.sparkSession
    name = "millrace_mix_decode" if decoding else "millrace_mix_encode"
    if not spark.catalog.functionExists(name):
        spark._jsparkSession.udf().register(name, _functions(spark)[decoding], spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return df.withColumn(column, F.call_udf(name, F.col(column)))


def encoded(df: DataFrame, column: str) -> DataFrame:
    """With ``column``, ids as little-endian u32, as a segment."""
    return _with(df, column, False)


def decoded(df: DataFrame, column: str) -> DataFrame:
    """With ``column``, a segment, as its ids in little-endian u32; a segment whose checksums don't hold fails the task."""
    return _with(df, column, True)
