"""Session settings the engine understands."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from .errors import InvalidParameter

_folders: set[str] = set()


def aggregate_pushdown(spark: SparkSession, on: bool = True) -> None:
    """Lets MIN, MAX and COUNT be answered from footers (needs the newer Parquet source)."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", str(on).lower())
    if on:
        spark.conf.set("spark.sql.sources.useV1SourceList", "")
    else:
        spark.conf.unset("spark.sql.sources.useV1SourceList")


def time_types(spark: SparkSession) -> None:
    """Reads TIME in microseconds as time, and TIMESTAMP in nanoseconds as a long."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")


def row_reader(spark: SparkSession, on: bool = True) -> None:
    """Reads row by row, which BYTE_STREAM_SPLIT needs."""
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", str(not on).lower())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table below spark.checkpoint.dir; a local folder stands in for it in local mode alone.

    The folders of an application are deleted when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise InvalidParameter("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints/lamella"
    folder = f"{base.rstrip('/')}/engine-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
    except (Py4JError, OSError, AttributeError):  # the JVM has ended: only a local folder can still be deleted
        if folder.startswith("file:///"):
            shutil.rmtree(folder[7:], ignore_errors=True)
