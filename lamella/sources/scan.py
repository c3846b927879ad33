"""Scans: projection, row ranges, and pruning by footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..operators.intervals import overlaps
from .footer import footers
from .pageindex import page_index
from .pages import read_rows

#: Rows of the stretches by which ranges meet row groups.
STRETCH = 1 << 20


def project(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named fields; a name that the files lack is an error."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c.split(".")[0] not in df.columns]
    if missing:
        raise InvalidParameter(f"no such columns: {missing}")
    return df.select(*columns)


def with_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows with row_index, their number within their file, and file_path."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.row_index").alias("row_index"), F.col("_metadata.file_path").alias("file_path"))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """The row_group view with first_row, the rows before a row group in its file, and table_row, those before it in all files by path.

    Sums over files see one number a file, sums over row groups those of one file.
    """
    groups = footers(spark, path, "row_group")
    before = F.sum("num_rows").over(Window.partitionBy("path").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1))
    files = groups.groupBy("path").agg(F.sum("num_rows").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("path", F.coalesce(earlier, F.lit(0)).alias("_base"))
    rows = groups.withColumn("first_row", F.coalesce(before, F.lit(0))).join(files, "path")
    return rows.withColumn("table_row", F.col("_base") + F.col("first_row")).drop("_base")


def row_ranges(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | DataFrame, columns: list[str] | None = None, by_file: bool = False, before: Column | None = None) -> DataFrame:
    """The rows whose number lies in one of the (start, length) ranges: a short list, or a table of any length.

    Rows are numbered over all files in the order of their paths, or with by_file=True within each
    file; before: an expression of path, the number of a file's first row where neither holds. Row groups that share no row with a range are not opened, and of the others only the pages
    are read that do (see pages.read_rows).
    """
    if isinstance(ranges, list):
        ranges = spark.createDataFrame([(int(a), int(n)) for a, n in ranges], "start long, length long")
    base = F.col("first_row" if by_file else "table_row") if before is None else F.col("first_row") + before
    groups = row_groups(spark, path).select("path", "row_group", base.alias("start"), F.col("num_rows").alias("length"))
    asked = ranges.select(F.col("start").alias("r_start"), F.col("length").alias("r_length"))
    met = overlaps(groups, asked, STRETCH)
    inside = F.struct((F.col("shared_start") - F.col("start")).alias("start"), F.col("shared_length").alias("length"))
    selected = met.groupBy("path", "row_group").agg(F.collect_list(inside).alias("selected"))
    return read_rows(selected, project(spark, path, columns or spark.read.parquet(path).columns).schema)


def kept_row_groups(spark: SparkSession, path: str, keep: Column) -> DataFrame:
    """The row groups for which a condition on the row_group view (see row_groups) holds."""
    return row_groups(spark, path).where(keep)


def pruned(spark: SparkSession, path: str, keep: Column, columns: list[str] | None = None) -> DataFrame:
    """The rows of the kept row groups; the others are never opened for reading."""
    schema = project(spark, path, columns or spark.read.parquet(path).columns).schema
    whole = F.lit(None).cast("array<struct<start:bigint,length:bigint>>")
    return read_rows(kept_row_groups(spark, path, keep).withColumn("selected", whole), schema)


def page_pruned(spark: SparkSession, path: str, column: str, keep: Column, columns: list[str] | None = None) -> DataFrame:
    """The rows of the pages of `column` for which a condition on the page_index view holds; of other columns, the pages with these rows."""
    # So many tasks read, however small the table of the pages is.
    pages = page_index(spark, path, [column]).where(keep).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "row_group")
    inside = F.struct(F.col("first_row").alias("start"), F.col("rows").alias("length"))
    selected = pages.groupBy("path", "row_group").agg(F.collect_list(inside).alias("selected"))
    return read_rows(selected, project(spark, path, columns or spark.read.parquet(path).columns).schema)
