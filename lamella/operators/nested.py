"""Nested columns as levels, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_levels(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, rep, def, value) of a nullable list of nullable elements.

    def is 0 for a null list, 1 for an empty one, 2 for a null element and 3 for a value.
    """
    rows = df.select(key, F.size(F.coalesce(column, F.array())).alias("_n"), F.col(column).isNull().alias("_none"), F.posexplode_outer(column).alias("pos", "value"))
    level = F.when(F.col("_none"), 0).when(F.col("_n") == 0, 1).when(F.col("value").isNull(), 2).otherwise(3)
    return rows.select(key, F.coalesce("pos", F.lit(0)).alias("pos"), (F.coalesce("pos", F.lit(0)) > 0).cast("int").alias("rep"), level.alias("def"), "value")


def list_assemble(levels: DataFrame, key: str) -> DataFrame:
    """(key, list) from list_levels' rows; each list is gathered by its own key."""
    entries = F.sort_array(F.collect_list(F.when(F.col("def") >= 2, F.struct("pos", "value"))))
    grouped = levels.groupBy(key).agg(F.max("def").alias("_d"), entries.alias("_e"))
    return grouped.select(key, F.when(F.col("_d") > 0, F.transform("_e", lambda x: x["value"])).alias("list"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(num_rows, num_values): level entries count null and empty lists once."""
    n = F.greatest(F.coalesce(F.size(column), F.lit(1)), F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("num_rows"), F.sum(n.cast("long")).alias("num_values"))


def definition_level(column: Column) -> Column:
    """Of a flat nullable column."""
    return column.isNotNull().cast("int")
