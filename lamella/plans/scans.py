"""Scans, projections and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.statistics import column_statistics, merge
from ..session import scratch
from ..sources import scan
from ..sources.pages import dictionaries
from .registry import query, table


@query("""SELECT l_returnflag, min(l_quantity) AS min_value, max(l_quantity) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS num_values
FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag""")
def scan_stats(spark, sf):
    rows = scan.project(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"]).where("l_quantity > 10")
    return column_statistics(rows, "l_quantity", [F.col("l_returnflag")])


@query("SELECT count(*) AS n, sum(l_orderkey) AS orderkeys, sum(l_linenumber) AS linenumbers, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity, count(DISTINCT l_returnflag || l_linestatus) AS flags, max(l_shipdate) AS last FROM lineitem")
def scan_full(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orderkeys"), F.sum("l_linenumber").alias("linenumbers"),
        F.round(F.sum("l_quantity")).cast("long").alias("quantity"), F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("flags"), F.max("l_shipdate").alias("last"),
    )


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders")
def scan_project(spark, sf):
    return scan.project(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_orderdate"])


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) WHERE r BETWEEN 100 AND 149 OR r BETWEEN 700 AND 709")
def scan_row_ranges(spark, sf):
    """Rows by number: the pages that hold them are read, by the offset index where a file has one."""
    return scan.row_ranges(spark, f"{sf}/events.parquet", [(100, 50), (700, 10)], ["event_id", "event_type"])


@query("SELECT vec_id, len(embedding) AS n, CAST(round(list_sum(embedding), 3) AS DOUBLE) AS total, label FROM embeddings")
def scan_nested_leaves(spark, sf):
    rows = scan.project(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding", "label"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 3).alias("total"), "label")


@query("SELECT count(*) AS num_rows FROM lineitem")
def row_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("num_rows"))


FOUR = "least(c_custkey // 400, 3)"


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE {FOUR} IN (SELECT {FOUR} FROM customer GROUP BY 1 HAVING count(*) = 400) AND c_acctbal > 0")
def prune_row_groups(spark, sf):
    """Of four files the row groups with 400 rows; the others are not read."""
    path = scratch(spark, "four")
    part = F.least(F.expr("c_custkey div 400"), F.lit(3)).cast("int")
    table(spark, sf, "customer").repartitionById(4, part).write.parquet(path)
    rows = scan.pruned(spark, path, F.col("num_rows") == 400, ["c_custkey", "c_mktsegment", "c_acctbal"])
    return rows.where("c_acctbal > 0").select("c_custkey", "c_mktsegment")


@query("SELECT 'o_orderpriority' AS column_path, o_orderpriority AS value FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders GROUP BY 2")
def dictionary_dump(spark, sf):
    """The entries of the dictionary pages."""
    return dictionaries(spark, f"{sf}/orders.parquet", ["o_orderpriority", "o_orderstatus"]).select("column_path", "value").distinct()


@query("""SELECT * FROM (SELECT 'nation' AS column_name, CAST(n_name AS VARCHAR) AS value, row_number() OVER (ORDER BY n_name) AS r FROM (SELECT DISTINCT n_name FROM nation)
 UNION ALL SELECT 'key', CAST(n_nationkey AS VARCHAR), row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR)) FROM (SELECT DISTINCT n_nationkey FROM nation)) WHERE r <= 5""".replace("SELECT * FROM (", "SELECT column_name, value FROM (", 1))
def dump_sample(spark, sf):
    from ..cli import dump

    named = F.when(F.col("column_name") == "n_name", "nation").otherwise("key")
    return dump(spark, f"{sf}/nation.parquet", 5, ["n_name", "n_nationkey"]).select(named.alias("column_name"), "value")


@query("SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS num_values FROM lineitem GROUP BY ALL")
def stats_reduce(spark, sf):
    """Statistics of stretches of keys, merged."""
    by = [F.col("l_returnflag"), F.col("l_linestatus")]
    parts = column_statistics(table(spark, sf, "lineitem"), "l_extendedprice", [*by, F.floor(F.col("l_orderkey") / 1000).alias("part")])
    return merge(parts, by)
