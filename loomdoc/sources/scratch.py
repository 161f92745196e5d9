"""New paths for what a query builds on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A path below spark.checkpoint.dir; below a temporary folder only in local mode without that setting. It goes when the program ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/loomdoc-{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder's owner clears what is left
        pass


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of each file below a path: what tells one state of a table from another."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)
