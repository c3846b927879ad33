"""Page indexes, page headers and bloom filters of Parquet files, a row for each page or chunk.

Tasks read footers and the ranges that footers point to, and no values.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .files import per_file
from .raw import CODECS, ENCODINGS, PAGES, Footer, named, opened

INDEX = (
    "path string, row_group int, column_path string, page int, first_row long, rows long, page_offset long, compressed_size long, "
    "null_count long, all_null boolean, min_value string, max_value string, min_raw binary, max_raw binary, boundary_order string, num_rows long"
)
HEADERS = (
    "path string, row_group int, column_path string, page int, page_type string, encoding string, codec string, num_values long, null_count long, "
    "page_offset long, header_size long, compressed_size long, uncompressed_size long, min_value string, max_value string"
)
FILTERS = "path string, row_group int, column_path string, blocks int, bitset binary"


def page_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each data page of each chunk with an offset index; first_row counts within the row group.

    Bounds are text by the column's type (see raw.Leaf) and raw bytes; pages of nulls alone have none.
    rows: how many rows the page has; num_rows: those of its row group.
    """

    def rows_of(name: str, length: int) -> Iterator[tuple]:
        with opened(name) as f:
            foot = Footer(f, size=length)
            for g, group, leaf, chunk in foot.chunks(columns):
                pages, index = foot.offsets(chunk), foot.bounds(chunk)
                for i, (offset, size, first) in enumerate(pages or ()):
                    end = pages[i + 1][2] if i + 1 < len(pages) else group[3]
                    known = index is not None and not index["nulls_only"][i]
                    low, high = (index["min"][i], index["max"][i]) if known else (None, None)
                    yield (
                        name, g, leaf.path, i, first, end - first, offset, size, index["nulls"][i] if index and index["nulls"] else None,
                        index["nulls_only"][i] if index else None, leaf.shown(low), leaf.shown(high), low, high, index["order"] if index else None, group[3],
                    )

    return per_file(spark, path, rows_of, INDEX)


def page_headers(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each page, dictionaries included, by the headers in the file; bodies are passed over."""

    def rows_of(name: str, length: int) -> Iterator[tuple]:
        with opened(name) as f:
            foot = Footer(f, size=length)
            for g, _, leaf, chunk in foot.chunks(columns):
                for i, (offset, size, x) in enumerate(foot.pages(chunk)):
                    head = x.get(5) or x.get(8) or x.get(7) or {}
                    stats = (x.get(5) or {}).get(5) or (x.get(8) or {}).get(8) or {}
                    nulls = head.get(2) if 8 in x else stats.get(3)
                    encoding = head.get(4) if 8 in x else head.get(2)
                    yield (
                        name, g, leaf.path, i, named(PAGES, x[1]), None if encoding is None else named(ENCODINGS, encoding), named(CODECS, chunk[3][4]), head.get(1), nulls,
                        offset, size, x[3], x[2], leaf.shown(stats.get(6)), leaf.shown(stats.get(5)),
                    )

    return per_file(spark, path, rows_of, HEADERS)


def filters(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The split-block bloom filter of each chunk that has one."""

    def rows_of(name: str, length: int) -> Iterator[tuple]:
        with opened(name) as f:
            foot = Footer(f, size=length)
            for g, _, leaf, chunk in foot.chunks(columns):
                bitset = foot.bloom(chunk)
                if bitset is not None:
                    yield name, g, leaf.path, len(bitset) // 32, bitset

    return per_file(spark, path, rows_of, FILTERS)
