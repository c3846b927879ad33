"""Writing and reading back; page indexes of written files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import scan
from ..sources.footer import footers, sidecar
from ..sources.pageindex import page_index
from ..sources.sink import CODECS, WriteOptions, write, write_arrow, write_parts, write_sidecar
from .registry import query, table


def summed(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


SUMS = "count(*) AS n, sum(o_orderkey) AS keys, sum(o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def write_roundtrip(spark, sf):
    path = scratch(spark, "orders")
    write(table(spark, sf, "orders"), path)
    return spark.read.parquet(path)


def each_way(spark, sf, ways: dict[str, WriteOptions]) -> DataFrame:
    out = []
    for name, options in ways.items():
        path = scratch(spark, "way")
        write(table(spark, sf, "orders"), path, options)
        out.append(summed(spark.read.parquet(path)).withColumn("way", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


@query(f"SELECT way, s.* FROM (VALUES ('v1'), ('v2')) AS w(way), (SELECT {SUMS} FROM orders) AS s")
def write_v1_v2(spark, sf):
    return each_way(spark, sf, {f"v{v}": WriteOptions(version=v) for v in (1, 2)})


@query(f"SELECT way, s.* FROM (VALUES {', '.join(f'({c!r})' for c in CODECS)}) AS w(way), (SELECT {SUMS} FROM orders) AS s")
def write_codecs(spark, sf):
    return each_way(spark, sf, {c: WriteOptions(codec=c) for c in CODECS})


@query(f"SELECT way, s.* FROM (VALUES ('zstd 1'), ('zstd 19'), ('gzip 1'), ('gzip 9')) AS w(way), (SELECT {SUMS} FROM orders) AS s")
def write_levels(spark, sf):
    return each_way(spark, sf, {f"{c} {n}": WriteOptions(codec=c, level=n) for c, n in (("zstd", 1), ("zstd", 19), ("gzip", 1), ("gzip", 9))})


@query("SELECT count(*) AS num_rows, true AS several FROM lineitem")
def write_row_groups(spark, sf):
    path = scratch(spark, "groups")
    write(table(spark, sf, "lineitem"), path, WriteOptions(row_group_bytes=1 << 17, page_rows=1000))
    return footers(spark, path, "row_group").agg(F.sum("num_rows").alias("num_rows"), (F.count(F.lit(1)) > 1).alias("several"))


@query("SELECT count(*) AS num_rows, CAST(4 AS BIGINT) AS files, CAST(4 AS BIGINT) AS row_groups, false AS absolute FROM orders")
def meta_sidecar(spark, sf):
    """A file of footers alone: the row groups of several files, by relative path."""
    path = scratch(spark, "parts")
    write(table(spark, sf, "orders").repartition(4), path)
    write_sidecar(spark, path)
    found = sidecar(spark, f"{path}/_metadata")
    absolute = F.bool_or(F.col("file_path").startswith("/") | F.col("file_path").contains(":"))
    return found.agg(F.sum("num_rows").alias("num_rows"), F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("row_groups"), absolute.alias("absolute"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def write_brotli(spark, sf):
    """Written and read by Arrow: Spark has no such codec here."""
    path = scratch(spark, "brotli")
    write_arrow(table(spark, sf, "orders"), path, WriteOptions(codec="brotli", level=5))
    return scan.pruned(spark, path, F.lit(True))


TWO = "least(event_id // 5000, 1)"
EVENT_PAGES = f"WITH r AS (SELECT CAST({TWO} AS INTEGER) AS file, row_number() OVER (PARTITION BY {TWO} ORDER BY event_id) - 1 AS row, * FROM events)"


#: Rows of a file on disk, 300 pages. The two files of the SQL are tables of such files, since the second has nearly all rows.
EVENT_PART = 300 * 500


def indexed(spark, sf) -> DataFrame:
    """The page index of events in two files, with pages of 500 rows; pages and first rows count on over a file's parts."""
    part = F.least(F.expr("event_id div 5000"), F.lit(1)).cast("int")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    parts = write_parts(rows, scratch(spark, "indexed"), part, "event_id", EVENT_PART, WriteOptions(page_rows=500))
    found = page_index(spark, parts.path).withColumn("_part", parts.part(F.col("path")))
    found = found.withColumn("file", parts.table(F.col("_part"))).withColumn("_before", parts.before(F.col("_part")))
    return found.withColumn("page", F.expr("CAST(page + _before div 500 AS INT)")).withColumn("first_row", F.col("first_row") + F.col("_before")).drop("_part", "_before")


@query(EVENT_PAGES + " SELECT file, c AS column_path, CAST(row // 500 AS INTEGER) AS page, min(row) AS first_row, count(*) AS rows, true AS apart FROM r, (VALUES ('event_id'), ('user_id'), ('event_type'), ('value')) AS t(c) GROUP BY 1, 2, 3")
def page_locations(spark, sf):
    """Each page's rows; a page's bytes lie behind those of the page before it."""
    before = Window.partitionBy("path", "row_group", "column_path").orderBy("page")
    apart = F.coalesce(F.col("page_offset") >= F.lag(F.col("page_offset") + F.col("compressed_size")).over(before), F.lit(True))
    return indexed(spark, sf).select("file", "column_path", "page", "first_row", "rows", apart.alias("apart"))


@query(EVENT_PAGES + """, b AS (SELECT file, row // 500 AS page, 'event_id' AS column_path, CAST(event_id AS VARCHAR) AS v, CAST(event_id AS DOUBLE) AS x FROM r
 UNION ALL SELECT file, row // 500, 'user_id', CAST(user_id AS VARCHAR), CAST(user_id AS DOUBLE) FROM r UNION ALL SELECT file, row // 500, 'event_type', event_type, NULL FROM r UNION ALL SELECT file, row // 500, 'value', NULL, value FROM r)
SELECT file, CAST(page AS INTEGER) AS page, column_path, min(x) AS low, max(x) AS high, CASE WHEN column_path = 'event_type' THEN min(v) END AS low_text, CASE WHEN column_path = 'event_type' THEN max(v) END AS high_text, CAST(0 AS BIGINT) AS nulls FROM b GROUP BY 1, 2, 3""")
def page_index_stats(spark, sf):
    """Every page's bounds, by the column's type."""
    text = F.col("column_path") == "event_type"
    bound = [F.when(~text, F.col(c).try_cast("double")).alias(n) for c, n in (("min_value", "low"), ("max_value", "high"))]
    shown = [F.when(text, F.col(c)).alias(n) for c, n in (("min_value", "low_text"), ("max_value", "high_text"))]
    return indexed(spark, sf).select("file", "page", "column_path", *bound, *shown, F.col("null_count").alias("nulls"))
