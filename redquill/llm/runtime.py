"""Session helpers that the operators of this package share."""

from __future__ import annotations

import gc
import re
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; a temporary one only where all runs on this machine."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="redquill-checkpoint-"))
        known = sc.getCheckpointDir()
    return known


def release(spark: SparkSession) -> None:
    """Free what finished plans hold: the driver's heap shrinks, and the shuffles, broadcasts and checkpoints that nothing names any more go.

    Spark drops those only after the driver's collector has run, and without a call it runs when the heap is full.
    """
    gc.collect()  # Python's references hold the JVM's objects
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Give native memory that the driver's JVM has freed back to the system, which glibc keeps in an arena for each of many threads; what the JVM says, None if it can't."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # By the interface's method: the server's own class is closed to other modules.
        kind = jvm.java.lang.Class.forName
        types = new(jvm.java.lang.Class, 4)
        for i, c in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(c)
        args = new(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args)
    except Py4JError:  # not Linux with glibc, or an older JVM
        return None


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, cut its lineage, and free what went before."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    release(df.sparkSession)
    return out


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of whole texts: at most so many rows and about so many bytes, for this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
