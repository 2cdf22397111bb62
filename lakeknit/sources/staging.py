"""Tables written between steps in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder of ``spark.checkpoint.dir`` and read it again; a temporary folder only where none is set and all run in one process."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lakeknit-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/lakeknit-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Give the system back what the driver's many threads have freed; whether its JVM can.

    The C library keeps that in an arena for each of them, over 100 MB after a hundred queries.
    """
    try:
        gateway = spark.sparkContext._gateway
        lang, kinds = gateway.jvm.java.lang, gateway.jvm.javax.management
        call = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = gateway.new_array(lang.Object, 4)
        given[0], given[1] = kinds.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = gateway.new_array(lang.Object, 0), gateway.new_array(lang.String, 0)
        return "Trim native heap" in call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except (Py4JError, StopIteration):  # another C library or an older JVM
        return False
