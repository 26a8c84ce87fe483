"""Folders for streams' state and tables' versions in the place that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the session's spark.checkpoint.dir, removed when the driver ends. Where that is unset, a temporary folder, if
    all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="tidefold-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/tidefold/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path
