"""Intermediate tables in the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Where it is unset, a
temporary one is made and set if the master is one local process, as in tests;
a cluster without that setting is refused. Tables are Parquet files, so a
lost executor costs the reruns of its tasks alone and nothing is read from
an executor's own disk.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: A table that took so many seconds may have left large shuffle files.
LONG_S = 1.0


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts are long: once a session, whatever its queries."""
    held = spark.conf.get(_BATCH, None)
    if held is None or not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _array(spark: SparkSession, kind: str, items: list):
    gateway = spark.sparkContext._gateway
    out = gateway.new_array(getattr(gateway.jvm.java.lang, kind), len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out


def trim(spark: SparkSession) -> str:
    """Have the driver's C library return what the JVM's compiler and other native code have freed; what the JVM says of it.

    A driver of many small stages sees that grow by hundreds of MB otherwise. Only
    JVMs on Linux can; of others it is an error.
    """
    jvm = spark.sparkContext._jvm
    kind, beans = jvm.java.lang.Class.forName, jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    takes = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    # by the public interface, as the server's own class isn't open to callers
    invoke = kind("javax.management.MBeanServer").getMethod("invoke", _array(spark, "Class", [kind(x) for x in takes]))
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    return invoke.invoke(beans, _array(spark, "Object", [name, "systemTrimNativeHeap", None, None]))


def release(spark: SparkSession) -> None:
    """Let the driver give back what it no longer uses: heap, the shuffle files of plans that are garbage, freed native memory."""
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(Py4JError):
        trim(spark)


class Scratch:
    """Tables of one run; those still there are removed as the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        bounded(spark)
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> Table:
        """Write a table, let go of the shuffle files behind it, and read it back."""
        self.n += 1
        path, schema, began = f"{self.root}/{self.n}", df.schema, time.monotonic()
        df.write.option("compression", "zstd").parquet(path)
        del df
        if time.monotonic() - began > LONG_S:  # shorter ones leave little behind, and wait for the next
            release(self.spark)
        return Table(self.spark.read.schema(schema).parquet(path), self, path)

    def drop(self, path: str | None = None) -> None:
        try:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path or self.root)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session has ended: its folder goes with the cluster's
            return


class Table:
    def __init__(self, df: DataFrame, scratch: Scratch, path: str) -> None:
        self.df, self._scratch, self._path = df, scratch, path

    def drop(self) -> None:
        """To be called once everything made from it is written."""
        self._scratch.drop(self._path)
