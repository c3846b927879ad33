"""Writing files: codec, level, version, page and row-group sizes, statistics, filters, sidecars."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FeatureNotActive, FeatureNotSupported, InvalidParameter, OutOfSpec
from .files import per_file
from .raw import opened

#: Codecs that Spark writes without further libraries (fixed values).
CODECS = ("none", "snappy", "gzip", "zstd", "lz4", "lz4_raw")
LEVELS = {"gzip": (0, 9), "zstd": (1, 22), "brotli": (0, 11)}
#: Keys of a stretch within which one task numbers rows.
STRETCH = 1 << 14


@dataclass
class WriteOptions:
    codec: str = "snappy"
    level: int | None = None
    version: int = 1
    statistics: bool = True
    dictionary: bool = True
    page_bytes: int | None = None
    page_rows: int | None = None
    row_group_bytes: int | None = None
    bloom: dict[str, int] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        if self.codec == "brotli":
            raise FeatureNotActive("Spark has no brotli codec here; write_arrow writes it")
        if self.codec not in CODECS:
            raise FeatureNotSupported(f"codec {self.codec}")
        if self.version not in (1, 2):
            raise InvalidParameter(f"version {self.version}")
        out = {"compression": self.codec, "parquet.writer.version": f"v{self.version}", "parquet.column.statistics.enabled": str(self.statistics).lower(), "parquet.enable.dictionary": str(self.dictionary).lower()}
        if self.level is not None:
            low, high = LEVELS.get(self.codec, (1, 0))
            if not low <= self.level <= high:
                raise InvalidParameter(f"level {self.level} of {self.codec}")
            out |= {"parquet.compression.codec.zstd.level": str(self.level)} if self.codec == "zstd" else {"zlib.compress.level": ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")[self.level]}
        for key, value in (("parquet.page.size", self.page_bytes), ("parquet.page.row.count.limit", self.page_rows), ("parquet.block.size", self.row_group_bytes)):
            if value is not None:
                out[key] = str(value)
        for column, distinct in self.bloom.items():
            out |= {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(distinct)}
        return out


def write(df: DataFrame, path: str, options: WriteOptions = WriteOptions(), mode: str = "errorifexists") -> None:
    df.write.options(**options.options()).mode(mode).parquet(path)


@dataclass(frozen=True)
class Parts:
    """Where the rows lie of tables whose files have `rows` rows each: (a table's number, the number of its first file), ascending."""

    path: str
    rows: int
    firsts: list[tuple[int, int]]

    def part(self, path: Column) -> Column:
        """The number of a file, by its name."""
        return F.substring_index(F.substring_index(path, "/part-", -1), "-", 1).cast("long")

    def _by_part(self, part: Column, value) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("long"))
        for table, first in reversed(self.firsts):
            out = out.when(part >= first, value(table, first))
        return out

    def table(self, part: Column) -> Column:
        """The number of the table that a file belongs to."""
        return self._by_part(part, lambda table, first: F.lit(table)).cast("int")

    def before(self, part: Column) -> Column:
        """How many rows of its table stand in the files before a file."""
        return self._by_part(part, lambda table, first: (part - first) * self.rows)


def write_parts(df: DataFrame, path: str, table: Column, key: str, rows: int, options: WriteOptions = WriteOptions()) -> Parts:
    """Writes tables in the order of an integer key, each as files of `rows` rows, of which only its last may have fewer.

    table: a row's table. No task gets a table: rows are numbered within stretches of keys, what stands
    before a stretch is counted, and a task writes one file. The numbers of the tables' rows pass
    through the driver; nulls come last.
    """
    # No key of 64 bits reaches this stretch.
    stretch = F.coalesce(F.expr(f"`{key}` div {STRETCH}").cast("long"), F.lit((1 << 63) - 1))
    keyed = df.select("*", table.alias("_table"), stretch.alias("_stretch"))
    counts = keyed.groupBy("_table", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    firsts, total = [], 0
    for r in counts.groupBy("_table").agg(F.sum("_n").alias("n")).orderBy("_table").collect():
        firsts.append((r["_table"], total))
        total += -(-r["n"] // rows)
    tasks = max(total, 1)
    earlier = F.sum("_n").over(Window.partitionBy("_table").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_table", "_stretch", F.coalesce(earlier, F.lit(0)).alias("_base"))
    # All columns are in the order, so that a task that is repeated numbers rows of equal keys alike.
    order = [F.col(key).asc_nulls_last(), *(c for c in df.columns if c != key)]
    within = F.row_number().over(Window.partitionBy("_table", "_stretch").orderBy(*order))
    numbered = keyed.repartition(tasks, "_table", "_stretch").withColumn("_at", within - 1).join(bases, ["_table", "_stretch"]).withColumn("_at", F.col("_base") + F.col("_at"))
    first = F.lit(0)
    for number, n in firsts:
        first = F.when(F.col("_table") == number, F.lit(n)).otherwise(first)
    part = (first + F.expr(f"_at div {rows}")).cast("int")
    write(numbered.repartitionById(tasks, part).sortWithinPartitions("_at").select(*df.columns), path, options)
    return Parts(path, rows, firsts)


def _target(folder: str, name: str) -> pa.NativeFile:
    """A new file in a folder of any store that Arrow writes to."""
    from pyarrow import fs

    local = folder if not folder.startswith("file:") else "/" + folder[5:].lstrip("/")
    system, inner = (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)
    system.create_dir(inner, recursive=True)
    return system.open_output_stream(f"{inner}/{name}")


def write_arrow(df: DataFrame, path: str, options: WriteOptions = WriteOptions(codec="brotli", level=1), group_rows: int = 1 << 17) -> list[str]:
    """Writes with Arrow, a file for each partition, what Spark has no codec for; returns the files' names.

    Read such files by scan.pruned or scan.row_ranges, which use Arrow too. A task that is repeated
    writes a file of its own; only the files that are returned count, and others are deleted.
    """
    if options.codec not in (*CODECS, "brotli"):
        raise FeatureNotSupported(f"codec {options.codec}")
    low, high = LEVELS.get(options.codec, (1, 0))
    if options.level is not None and not low <= options.level <= high:
        raise InvalidParameter(f"level {options.level} of {options.codec}")
    wanted = {"none": "none", "lz4_raw": "lz4"}.get(options.codec, options.codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        name = f"part-{uuid.uuid4().hex}.parquet"
        for batch in batches:
            if writer is None:
                sink = _target(path, name)
                writer = pq.ParquetWriter(
                    sink, batch.schema, compression=wanted, compression_level=options.level, use_dictionary=options.dictionary, write_statistics=options.statistics,
                    data_page_version=f"{options.version}.0", write_page_index=options.statistics, **({"data_page_size": options.page_bytes} if options.page_bytes else {}),
                )
            writer.write_batch(batch, group_rows)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.record_batch([pa.array([name])], ["name"])

    names = sorted(r["name"] for r in df.mapInArrow(run, "name string").collect())
    spark = df.sparkSession
    for other in spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(path).select("path").collect() if names else []:
        if other["path"].rsplit("/", 1)[1] not in names:
            found = spark._jvm.org.apache.hadoop.fs.Path(other["path"])
            found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, False)
    return names


def write_sidecar(spark: SparkSession, root: str, name: str = "_metadata") -> int:
    """Writes a file that is nothing but the footer of all files below root, with their relative paths; returns its row groups.

    Footers are read by tasks; the one file that they make up is put together by the driver, in order of path.
    """

    def rows_of(path: str, length: int) -> Iterator[tuple]:
        with opened(path) as f:
            out = pa.BufferOutputStream()
            pq.ParquetFile(f).metadata.write_metadata_file(out)
            yield path, out.getvalue().to_pybytes()

    start = len(re.sub(r"^\w+:/+", "/", root).rstrip("/")) + 1
    whole = None
    for row in per_file(spark, root, rows_of, "path string, footer binary").orderBy("path").toLocalIterator():
        one = pq.read_metadata(pa.BufferReader(row["footer"]))
        one.set_file_path(re.sub(r"^\w+:/+", "/", row["path"])[start:])
        if whole is None:
            whole = one
        elif not whole.schema.equals(one.schema):
            raise OutOfSpec(f"{row['path']} has another schema than the files before it")
        else:
            whole.append_row_groups(one)
    if whole is None:
        raise InvalidParameter(f"no files below {root}")
    with _target(root, name) as f:
        whole.write_metadata_file(f)
    return whole.num_row_groups
