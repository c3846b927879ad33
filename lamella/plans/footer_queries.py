"""Metadata as tables. The SQL names the files of the scale that is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.footer import chunk_bytes, footers
from .registry import query

SF = "/root/testdata/sf0.01"


def name_of(path="path"):
    return F.regexp_extract(path, r"([^/]+)\.parquet", 1).alias("file")


META = f"parquet_metadata('{SF}/lineitem.parquet')"


@query(f"SELECT regexp_extract(file_name, '([^/]+)\\.parquet', 1) AS file, num_rows, num_row_groups, created_by FROM parquet_file_metadata(['{SF}/orders.parquet', '{SF}/part.parquet'])")
def meta_file(spark, sf):
    rows = footers(spark, f"{sf}/orders.parquet").unionByName(footers(spark, f"{sf}/part.parquet"))
    return rows.select(name_of(), "num_rows", "num_row_groups", "created_by")


@query(f"SELECT row_group_id AS row_group, any_value(row_group_num_rows) AS num_rows, count(*) AS num_columns, any_value(row_group_bytes) AS total_byte_size, CAST(sum(total_compressed_size) AS BIGINT) AS compressed_size FROM {META} GROUP BY 1")
def meta_row_groups(spark, sf):
    return footers(spark, f"{sf}/lineitem.parquet", "row_group").drop("path")


@query(f"SELECT row_group_id AS row_group, column_id, path_in_schema AS column_path, type AS physical, num_values, lower(compression) AS codec, data_page_offset, total_compressed_size AS compressed_size, total_uncompressed_size AS uncompressed_size FROM {META}")
def meta_column_chunks(spark, sf):
    return footers(spark, f"{sf}/lineitem.parquet", "chunk").select("row_group", "column_id", "column_path", "physical", "num_values", F.lower("codec").alias("codec"), "data_page_offset", "compressed_size", "uncompressed_size")


@query(f"SELECT path_in_schema AS column_path, coalesce(nullif(dictionary_page_offset, 0), data_page_offset) AS start, total_compressed_size AS length FROM {META}")
def chunk_byte_range(spark, sf):
    return footers(spark, f"{sf}/lineitem.parquet", "chunk").select("column_path", "start", F.col("compressed_size").alias("length"))


@query(f"SELECT row_group_id AS row_group, min(coalesce(nullif(dictionary_page_offset, 0), data_page_offset)) AS file_offset FROM {META} GROUP BY 1")
def meta_rg_offset(spark, sf):
    return footers(spark, f"{sf}/lineitem.parquet", "chunk").groupBy("row_group").agg(F.min("start").alias("file_offset"))


@query(f"SELECT path_in_schema AS column_path, stats_null_count AS null_count, stats_min_value AS low, stats_max_value AS high FROM {META} WHERE type IN ('INT64', 'INT32', 'BYTE_ARRAY') AND path_in_schema <> 'l_shipdate'")
def meta_column_stats(spark, sf):
    rows = footers(spark, f"{sf}/lineitem.parquet", "chunk").where("physical in ('INT64', 'INT32', 'BYTE_ARRAY') and column_path <> 'l_shipdate'")
    return rows.select("column_path", F.col("stats_null_count").alias("null_count"), F.col("stats_min").alias("low"), F.col("stats_max").alias("high"))


@query(f"SELECT list_aggregate(list_sort(list_distinct(flatten(list(string_split(encodings, ', '))))), 'string_agg', ',') AS encodings, count(DISTINCT compression) AS codecs FROM {META}")
def meta_encodings(spark, sf):
    rows = footers(spark, f"{sf}/lineitem.parquet", "chunk")
    codecs = rows.agg(F.countDistinct("codec").alias("codecs"))
    names = rows.select(F.explode("encodings").alias("e")).agg(F.array_join(F.sort_array(F.collect_set("e")), ",").alias("encodings"))
    return names.join(codecs, F.lit(True))


@query(f"SELECT path_in_schema AS column_path, type AS physical, total_compressed_size AS compressed_size, round(total_uncompressed_size / total_compressed_size, 2) AS ratio FROM {META}")
def meta_report(spark, sf):
    from ..cli import meta_report as report

    return report(spark, f"{sf}/lineitem.parquet").select("column_path", "physical", "compressed_size", "ratio")


@query(f"SELECT name, type AS physical FROM parquet_schema('{SF}/embeddings.parquet') WHERE type IS NOT NULL")
def meta_schema(spark, sf):
    return footers(spark, f"{sf}/embeddings.parquet", "schema").select("name", "physical")


@query(f"SELECT 'orders' AS file, decode(key) AS key, CAST(octet_length(value) AS INTEGER) AS length FROM parquet_kv_metadata('{SF}/orders.parquet')")
def meta_kv(spark, sf):
    return footers(spark, f"{sf}/orders.parquet", "kv").select(name_of(), "key", F.octet_length("value").alias("length"))


@query(f"SELECT path_in_schema AS column_path, num_values FROM {META}")
def meta_json(spark, sf):
    """Metadata rows as JSON text, and read again."""
    text = footers(spark, f"{sf}/lineitem.parquet", "chunk").select(F.to_json(F.struct("column_path", "num_values", "encodings")).alias("j"))
    return text.select(F.from_json("j", "column_path string, num_values long").alias("x")).select("x.*")


@query(f"SELECT row_group_id AS row_group, path_in_schema AS column_path, total_compressed_size AS size FROM {META}")
def raw_chunk_bytes(spark, sf):
    """The bytes of each chunk of a file, by its byte range."""
    pieces = chunk_bytes(spark, f"{sf}/lineitem.parquet").select("path", "row_group", "column_path", F.octet_length("content").cast("long").alias("n"))
    return pieces.groupBy("path", "row_group", "column_path").agg(F.sum("n").alias("size")).drop("path")
