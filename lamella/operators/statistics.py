"""Column statistics: minimum, maximum and null count, by group, and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_statistics(df: DataFrame, column: str | Column, by: list[Column] = []) -> DataFrame:
    """min_value, max_value, null_count and num_values of a column for each group."""
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(*by).agg(
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
        F.count_if(c.isNull()).alias("null_count"),
        F.count(F.lit(1)).alias("num_values"),
    )


def merge(statistics: DataFrame, by: list[Column] = []) -> DataFrame:
    """Statistics of the whole from those of its parts.

    An unknown null count of a part makes the sum unknown; parts without values have no bounds.
    """
    return statistics.groupBy(*by).agg(
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.when(F.count_if(F.col("null_count").isNull()) == 0, F.sum("null_count")).alias("null_count"),
        F.sum("num_values").alias("num_values"),
    )


def boundary_order(statistics: DataFrame, part: str, by: list[str] = []) -> DataFrame:
    """ASCENDING, DESCENDING or UNORDERED over the parts in order; parts of nulls alone are passed over."""
    w = Window.partitionBy(*by).orderBy(part)
    low, high = F.lag("min_value").over(w), F.lag("max_value").over(w)
    steps = statistics.where(F.col("min_value").isNotNull()).select(
        *by,
        F.coalesce((F.col("min_value") >= low) & (F.col("max_value") >= high), F.lit(True)).alias("up"),
        F.coalesce((F.col("min_value") <= low) & (F.col("max_value") <= high), F.lit(True)).alias("down"),
    )
    order = F.when(F.bool_and("up"), "ASCENDING").when(F.bool_and("down"), "DESCENDING").otherwise("UNORDERED")
    return steps.groupBy(*by).agg(order.alias("boundary_order"))
