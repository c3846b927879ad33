"""Work on files as tables: a listing by Spark, and a task for some of its files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a task gives at once, and the bytes of text and binary values from which a batch is given earlier.
ROWS, BYTES = 1024, 1 << 22


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files below a path, found by Spark; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.where(~F.col("path").rlike(r"/[_.][^/]*$"))


def per_row(df: DataFrame, rows_of: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that rows_of(*row) gives for each row of df. Nothing passes through the driver.

    A task holds less than ROWS rows, and less than BYTES bytes besides its last row.
    """
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in waiting], target)
            waiting.clear()
            return out

        held = 0
        for some in batches:
            for row in zip(*(c.to_pylist() for c in some.columns)):
                for x in rows_of(*row):
                    waiting.append(x)
                    held += sum(len(v) for v in x if isinstance(v, (bytes, str)))
                    if len(waiting) == ROWS or held >= BYTES:
                        yield batch()
                        held = 0
        if waiting:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def per_file(spark: SparkSession, path: str, rows_of: Callable[[str, int], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that rows_of(path, length) gives for each file below a path."""
    return per_row(listing(spark, path), rows_of, schema)
