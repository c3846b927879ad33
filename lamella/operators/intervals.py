"""Row intervals of pages, and their transfer between columns.

Intervals are half-open: start and length, both in rows of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_row_intervals(pages: DataFrame, num_rows: int | Column, by: list[str], first: str = "first_row") -> DataFrame:
    """Adds start and length: a page ends where the next one of its column begins, or with the rows of its row group.

    by: what tells row groups apart, so that no window holds the pages of more than one.
    """
    following = F.lead(first).over(Window.partitionBy(*by).orderBy(first))
    return pages.withColumn("start", F.col(first).cast("long")).withColumn("length", (F.coalesce(following, F.lit(num_rows) if isinstance(num_rows, int) else num_rows) - F.col(first)).cast("long"))


def rows_from_pages(intervals: DataFrame, selected: Column) -> DataFrame:
    """The row intervals of the selected pages."""
    return intervals.where(selected).select("start", "length")


def covered(start: Column, length: Column, width: int) -> Column:
    """Numbers of the stretches of `width` rows that an interval touches (none if it is empty)."""
    last = F.floor((start + length - 1) / width)
    return F.when(length > 0, F.sequence(F.floor(start / width), last)).otherwise(F.array().cast("array<bigint>"))


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of intervals that share rows: columns of both, and the shared start and length.

    left has start and length, right has r_start and r_length. Both sides are dealt by stretches of
    `width` rows, so this is an equality join that shuffles; a pair is taken in the first stretch
    that it shares. No side is broadcast unless Spark knows it to be small.
    """
    a = left.withColumn("_stretch", F.explode(covered(F.col("start"), F.col("length"), width)))
    b = right.withColumn("_stretch", F.explode(covered(F.col("r_start"), F.col("r_length"), width)))
    shared = F.greatest("start", "r_start")
    end = F.least(F.col("start") + F.col("length"), F.col("r_start") + F.col("r_length"))
    joined = a.join(b, "_stretch").where((end > shared) & (F.floor(shared / width) == F.col("_stretch")))
    return joined.withColumn("shared_start", shared).withColumn("shared_length", end - shared).drop("_stretch")


def select_pages(intervals: DataFrame, pages: DataFrame, width: int, by: list[str] = []) -> DataFrame:
    """For each page (with start and length) the selected sub-ranges, relative to the page.

    Pages without selected rows stay, with an empty list, so that a leading dictionary page is
    still recognised by position. by: columns of pages that tell row groups apart.
    """
    rows = intervals.select(F.col("start").alias("r_start"), F.col("length").alias("r_length"))
    found = overlaps(pages, rows, width).groupBy(*by, "start").agg(
        F.sort_array(F.collect_list(F.struct((F.col("shared_start") - F.col("start")).alias("start"), F.col("shared_length").alias("length")))).alias("selected")
    )
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return pages.join(found, [*by, "start"], "left").withColumn("selected", F.coalesce("selected", none))


def rows_in(df: DataFrame, row: Column, intervals: DataFrame, width: int) -> DataFrame:
    """The rows of df whose number lies in one of the intervals: a semi join on stretches of rows."""
    rows = intervals.withColumn("_s", F.explode(covered(F.col("start"), F.col("length"), width))).select("_s", F.col("start").alias("_a"), (F.col("start") + F.col("length")).alias("_b"))
    keyed = df.withColumn("_row", row).withColumn("_s", F.floor(F.col("_row") / width))
    return keyed.join(rows, (keyed["_s"] == rows["_s"]) & (keyed["_row"] >= rows["_a"]) & (keyed["_row"] < rows["_b"]), "left_semi").drop("_row", "_s")


def filtered_runs(df: DataFrame, flag: Column, intervals: DataFrame, width: int, by: list[str] = ["page"], place: str = "place") -> DataFrame:
    """(by, start, length, selected, set_bits): stretches of rows inside and outside the intervals, in order.

    Intervals are disjoint and count rows by `place` within each group; set_bits counts the rows of a
    stretch whose flag is true, so for a gap the values that a reader has to pass over.
    """
    rows = intervals.withColumn("_s", F.explode(covered(F.col("start"), F.col("length"), width))).select("_s", F.col("start").alias("_a"), (F.col("start") + F.col("length")).alias("_b"))
    keyed = df.select(*by, F.col(place).alias("_p"), flag.alias("_f")).withColumn("_s", F.floor(F.col("_p") / width))
    met = keyed.join(rows, (keyed["_s"] == rows["_s"]) & (keyed["_p"] >= rows["_a"]) & (keyed["_p"] < rows["_b"]), "left").select(*by, "_p", "_f", F.col("_a").alias("_in"))
    w = Window.partitionBy(*by).orderBy("_p")
    # A new stretch begins where the interval changes; two that touch are told apart.
    fresh = (~F.col("_in").eqNullSafe(F.lag("_in").over(w)) | F.lag("_p").over(w).isNull()).cast("int")
    runs = met.withColumn("_n", fresh).withColumn("_run", F.sum("_n").over(w))
    grouped = runs.groupBy(*by, "_run").agg(F.min("_p").alias("start"), F.count(F.lit(1)).alias("length"), F.first("_in").isNotNull().alias("selected"), F.count_if("_f").alias("set_bits"))
    return grouped.drop("_run")
