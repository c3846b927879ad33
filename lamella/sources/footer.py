"""Footers as tables, read by the tasks that hold the files' names.

Views: file, row_group, chunk, schema, kv. Paths are found by Spark's own file listing, so that any
store it reads can be inspected; executors open them through Arrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from .files import BYTES, per_file, per_row
from .raw import Footer, opened, ranged

VIEWS = {
    "file": "path string, created_by string, format_version string, num_rows long, num_row_groups long, num_columns long, footer_size long",
    "row_group": "path string, row_group long, num_rows long, num_columns long, total_byte_size long, compressed_size long",
    "chunk": (
        "path string, row_group long, column_id long, column_path string, physical string, num_values long, codec string, encodings array<string>, "
        "data_page_offset long, dictionary_page_offset long, compressed_size long, uncompressed_size long, start long, "
        "stats_min string, stats_max string, stats_null_count long, stats_distinct_count long, has_column_index boolean, has_offset_index boolean"
    ),
    "schema": "path string, column_id long, column_path string, name string, physical string, logical string, converted string, max_def int, max_rep int",
    "kv": "path string, key string, value string",
}


def _rows(path: str, view: str) -> Iterator[tuple]:
    with pq.ParquetFile(opened(path)) as f:
        meta, schema = f.metadata, f.schema
        if view == "file":
            yield path, meta.created_by, meta.format_version, meta.num_rows, meta.num_row_groups, meta.num_columns, meta.serialized_size
        elif view == "row_group":
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                yield path, g, group.num_rows, group.num_columns, group.total_byte_size, sum(group.column(c).total_compressed_size for c in range(group.num_columns))
        elif view == "chunk":
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for i in range(group.num_columns):
                    c = group.column(i)
                    s = c.statistics if c.is_stats_set else None
                    bounds = s is not None and s.has_min_max
                    dictionary = c.dictionary_page_offset if c.has_dictionary_page else None
                    start = min(x for x in (dictionary, c.data_page_offset) if x)
                    yield (
                        path, g, i, c.path_in_schema, c.physical_type, c.num_values, c.compression, sorted(set(c.encodings)),
                        c.data_page_offset, dictionary, c.total_compressed_size, c.total_uncompressed_size, start,
                        str(s.min) if bounds else None, str(s.max) if bounds else None,
                        s.null_count if s is not None and s.has_null_count else None, s.distinct_count if s is not None and s.has_distinct_count else None,
                        c.has_column_index, c.has_offset_index,
                    )
        elif view == "schema":
            for i in range(len(schema)):
                c = schema.column(i)
                yield path, i, c.path, c.name, c.physical_type, str(c.logical_type), c.converted_type, c.max_definition_level, c.max_repetition_level
        elif view == "kv":
            for k, v in (meta.metadata or {}).items():
                yield path, k.decode("utf-8", "replace"), v.decode("utf-8", "replace")


def footers(spark: SparkSession, path: str, view: str = "file") -> DataFrame:
    """One of the VIEWS over all files below a path."""
    return per_file(spark, path, lambda name, length: _rows(name, view), VIEWS[view])


def chunk_bytes(spark: SparkSession, path: str, columns: list[str] | None = None, most: int = BYTES) -> DataFrame:
    """(path, row_group, column_path, start, content): the bytes of each chunk in pieces of at most `most` bytes, each with the place in the file where it starts.

    A chunk without bytes has one empty piece. Chunks are dealt over the session's number of shuffle
    partitions, also those of one file; a task reads its chunks' ranges and nothing else.
    """
    chunks = footers(spark, path, "chunk")
    if columns is not None:
        chunks = chunks.where(chunks["column_path"].isin(columns))

    def rows_of(name: str, g: int, column: str, start: int, size: int) -> Iterator[tuple]:
        with opened(name) as f:
            for at in range(0, max(size, 1), most):
                yield name, g, column, start + at, ranged(f, start + at, min(most, size - at))

    ranges = chunks.select("path", "row_group", "column_path", "start", "compressed_size")
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "row_group", "column_path")
    return per_row(dealt, rows_of, "path string, row_group long, column_path string, start long, content binary")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, row_group, num_rows) of the row groups that a file of footers alone names."""

    def rows_of(name: str) -> Iterator[tuple]:
        with opened(name) as f:
            for i, group in enumerate(Footer(f).groups):
                yield group[1][0].get(1, b"").decode(), i, group[3]

    return per_row(spark.createDataFrame([(path,)], "path string"), rows_of, "file_path string, row_group long, num_rows long")
