"""Shared scratch space: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session may name none, as in tests; it gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named and not current:
        context.setCheckpointDir(named)
    elif not named and not current:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-"))
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses (not created)."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker, where the session has Spark's default of 64 MB.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python workers in small batches, unless the session names a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m") in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, BATCH)


def settle(frame: DataFrame) -> DataFrame:
    """Compute the frame once, keep it in the shared folder and cut its lineage."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give back what nothing refers to any more: broadcast tables, shuffle files, kept frames.

    Spark removes them when the driver's garbage is collected, which a heap with
    room to grow puts off through very many small jobs. What the driver's JVM has
    freed outside its heap, as after compiling, goes back to the system as well:
    the C library keeps it otherwise, some 300 MB after the pipeline's jobs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Give the driver's freed native memory back, by the JVM's own management command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    asked = gateway.new_array(jvm.java.lang.Object, 4)
    asked[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    asked[1] = "systemTrimNativeHeap"
    # by the interface's method, as the server's own class isn't open to calls
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    # JVMs before 17.0.9, or without glibc, have no such command
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(server, asked)
