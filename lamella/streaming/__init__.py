"""Files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def running_statistics(stream: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Statistics of a column by group that each new file is merged into (for output mode complete)."""
    return stream.groupBy(*by).agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"), F.count_if(F.col(column).isNull()).alias("null_count"), F.count(F.lit(1)).alias("num_values"))
