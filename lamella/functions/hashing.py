"""xxh64 with seed 0, as split-block bloom filters want it (Spark's own function has seed 42)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _xxh64(value: Column) -> Column:
    """Spark's expression with another seed, evaluated in the JVM; null for null."""
    jvm = SparkSession.active()._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    one = jvm.PythonUtils.toSeq([bridge.expression(value._jc)])
    return F.when(value.isNotNull(), Column(bridge.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(one, 0))))


def xxh64_bytes(value: Column) -> Column:
    """Of a string's UTF-8 or of binary."""
    return _xxh64(value.cast("binary"))


def xxh64_number(value: Column, size: int) -> Column:
    """Of a whole number's 4 or 8 little-endian bytes."""
    return _xxh64(value.cast({4: "int", 8: "long"}[size]))
