"""Reading only the pages that hold wanted rows, by a file's own offset index.

Spark prunes pages by pushed predicates on values, but has no way to ask for rows by number. Here a
task gets row groups with the row intervals wanted of each; of every column it reads the dictionary,
if there is one, and the pages that share rows with the intervals, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import InvalidParameter, OutOfSpec, WouldOverAllocate
from ..functions import pagecodecs
from ..functions.compact import Reader
from .files import per_file
from .raw import CODECS, ENCODINGS, HEADER, Footer, Leaf, decompressed, named, opened, ranged

#: Bytes of a page, uncompressed, at most.
MOST_PAGE = 1 << 30
#: Rows of a batch that a task gives at once.
ROWS = 8192


def body(codec: str, header: dict, raw: bytes, most: int = MOST_PAGE) -> tuple[bytes, bytes, bytes] | bytes:
    """The uncompressed body of a page; of version 2 the levels, which are never compressed, apart from the values."""
    if header[2] > most:
        raise WouldOverAllocate(f"a page has {header[2]} bytes, {most} are allowed")
    if header[1] != 3:
        return decompressed(codec, raw, header[2])
    x = header[8]
    rep, dfn, values = pagecodecs.split_v2(raw, x[6], x[5])
    if x.get(7, True) and header[2] > len(rep) + len(dfn):
        values = decompressed(codec, values, header[2] - len(rep) - len(dfn))
    return rep, dfn, values


def dictionary(foot: Footer, chunk: dict, leaf: Leaf):
    """A chunk's dictionary, or none. It stands before the data pages."""
    meta = chunk[3]
    at = min(x for x in (meta.get(11), meta[9]) if x)
    head = Reader(foot.file.read_at(HEADER, at))
    x = head.struct()
    if x[1] != 2:
        return None
    return pagecodecs.plain(body(named(CODECS, meta[4]), x, ranged(foot.file, at + head.at, x[3])), leaf, x[7][1])


def page_values(foot: Footer, chunk: dict, leaf: Leaf, offset: int, entries):
    """(values present, validity or None) of a data page of a flat column."""
    head = Reader(foot.file.read_at(HEADER, offset))
    x = head.struct()
    raw = ranged(foot.file, offset + head.at, x[3])
    found = body(named(CODECS, chunk[3][4]), x, raw)
    if x[1] == 0:
        n, encoding = x[5][1], x[5][2]
        _, levels, values = pagecodecs.split_v1(found, leaf.max_def, leaf.max_rep)
    elif x[1] == 3:
        n, encoding = x[8][1], x[8][4]
        _, levels, values = found
    else:
        raise OutOfSpec("no data page stands where the index says")
    valid = pagecodecs.hybrid(levels, 1, n).astype(bool) if leaf.max_def else None
    present = n if valid is None else int(valid.sum())
    return pagecodecs.decoded(values, named(ENCODINGS, encoding), leaf, present, entries), valid


def touched(pages: list[tuple[int, int, int]], num_rows: int, wanted: list[tuple[int, int]]) -> list[int]:
    """Numbers of the pages that share rows with one of the ascending, disjoint intervals (start, length)."""
    first = np.array([p[2] for p in pages] + [num_rows])
    out: set[int] = set()
    for start, length in wanted:
        if length > 0:
            out.update(range(max(0, int(np.searchsorted(first, start, "right")) - 1), min(len(pages), int(np.searchsorted(first, start + length, "left")))))
    return sorted(out)


def flat_column(foot: Footer, group: dict, chunk: dict, leaf: Leaf, wanted: list[tuple[int, int]], target: pa.DataType) -> pa.Array | None:
    """The wanted rows of a column whose chunk has an offset index, or None where it has none."""
    pages = foot.offsets(chunk)
    if pages is None:
        return None
    entries = dictionary(foot, chunk, leaf)
    out = []
    for i in touched(pages, group[3], wanted):
        start = pages[i][2]
        end = pages[i + 1][2] if i + 1 < len(pages) else group[3]
        column = pagecodecs.arrow(*page_values(foot, chunk, leaf, pages[i][0], entries), leaf, target)
        if len(column) != end - start:
            raise OutOfSpec("a page has another number of rows than its index says")
        for a, n in wanted:
            lo, hi = max(a, start), min(a + n, end)
            if lo < hi:
                out.append(column.slice(lo - start, hi - lo))
    return pa.concat_arrays(out) if out else pa.array([], target)


def merged(intervals: list[dict]) -> list[tuple[int, int]]:
    """Ascending, disjoint (start, length) of intervals in any order that may overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["start"] + x["length"]) for x in intervals if x["length"] > 0):
        if out and start <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), end) - out[-1][0])
        else:
            out.append((start, end - start))
    return out


def read_rows(groups: DataFrame, schema: StructType) -> DataFrame:
    """The rows of (path, row_group, selected), where selected lists the row intervals (start, length) wanted.

    Intervals count rows within the row group; null stands for all its rows. Columns are those of
    the schema. Columns that are nested, and chunks without an offset index, are read whole with their
    row group and then cut. The intervals of one row group must fit in a task's memory.
    """
    if not schema.fields:
        raise InvalidParameter("at least one column has to be read")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, g, selected in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with opened(path) as f:
                    yield from _group(f, g, selected)

    def _group(f: pa.NativeFile, g: int, selected: list[dict] | None) -> Iterator[pa.RecordBatch]:
        if selected is None:
            for some in pq.ParquetFile(f).iter_batches(ROWS, row_groups=[g], columns=target.names):
                yield from pa.Table.from_batches([some]).select(target.names).cast(target).to_batches()
            return
        foot = Footer(f)
        group = foot.groups[g]
        wanted = [(a, min(a + n, group[3]) - a) for a, n in merged(selected) if a < group[3]]
        flat = {leaf.path: (leaf, chunk) for leaf, chunk in zip(foot.leaves, group[1]) if "." not in leaf.path and not leaf.max_rep}
        columns: dict[str, pa.Array] = {}
        for field in target:
            if field.name in flat:
                leaf, chunk = flat[field.name]
                found = flat_column(foot, group, chunk, leaf, wanted, field.type)
                if found is not None:
                    columns[field.name] = found
        rest = [x for x in target.names if x not in columns]
        if rest:
            whole = pq.ParquetFile(f).read_row_group(g, rest).select(rest)
            parts = [whole.slice(a, n) for a, n in wanted] or [whole.slice(0, 0)]
            cut = pa.concat_tables(parts).cast(pa.schema([target.field(x) for x in rest]))
            columns |= {x: cut[x].combine_chunks() for x in rest}
        yield from pa.table([columns[x] for x in target.names], schema=target).to_batches(ROWS)

    return groups.select("path", "row_group", "selected").mapInArrow(run, schema)


def dictionaries(spark: SparkSession, path: str, columns: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """(path, row_group, column_path, idx, value): the entries, as text, of each chunk's dictionary page; sample: the first so many."""

    def rows_of(name: str, length: int) -> Iterator[tuple]:
        with opened(name) as f:
            foot = Footer(f, size=length)
            for g, _, leaf, chunk in foot.chunks(columns):
                entries = dictionary(foot, chunk, leaf)
                for i, x in enumerate([] if entries is None else entries[:sample]):
                    shown = leaf.shown(x) if isinstance(x, bytes) else repr(x.item()) if isinstance(x, np.floating) else str(x)
                    yield name, g, leaf.path, i, shown

    return per_file(spark, path, rows_of, "path string, row_group int, column_path string, idx int, value string")
