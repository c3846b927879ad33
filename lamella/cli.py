"""Command line: rowcount, meta and dump of Parquet files. dump shows dictionary entries, or with -v values of any column.

python -m lamella.cli rowcount PATH
python -m lamella.cli meta [-e] [-s] PATH
python -m lamella.cli dump [-s N] [-c COLUMN,...] [-v] PATH
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.footer import footers
from .sources.pages import dictionaries


def rowcount(spark: SparkSession, path: str) -> int:
    return footers(spark, path, "file").agg(F.sum("num_rows")).first()[0] or 0


def meta_report(spark: SparkSession, path: str) -> DataFrame:
    """A line for each column chunk: offset, rows, sizes, ratio, encodings and statistics."""
    chunks = footers(spark, path, "chunk")
    ratio = F.round(F.col("uncompressed_size") / F.col("compressed_size"), 2)
    return chunks.select("path", "row_group", "column_path", "physical", "codec", F.col("start").alias("offset"), F.col("num_values"), "compressed_size", "uncompressed_size", ratio.alias("ratio"), F.concat_ws(",", "encodings").alias("encodings"), "stats_min", "stats_max", "stats_null_count")


def dump(spark: SparkSession, path: str, sample: int = 5, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value): the least `sample` distinct values of each chosen column as text."""
    df = spark.read.parquet(path)
    from pyspark.sql import Window

    chosen = columns or df.columns
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in chosen])).alias("x"))
    distinct = cells.where("x.value is not null").groupBy("x.column_name", "x.value").count().drop("count")
    return distinct.withColumn("n", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).where(F.col("n") <= sample).drop("n")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lamella", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("rowcount", "meta", "dump"):
        commands.add_parser(name).add_argument("path")
    commands.choices["meta"].add_argument("-e", "--extra", action="store_true", help="with key-value metadata")
    commands.choices["meta"].add_argument("-s", "--stats", action="store_true", help="with statistics")
    commands.choices["dump"].add_argument("-s", "--sample", type=int, default=5)
    commands.choices["dump"].add_argument("-c", "--columns", type=lambda x: x.split(","))
    commands.choices["dump"].add_argument("-v", "--values", action="store_true", help="values of any column instead of dictionary entries")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "rowcount":
        print(f"Total RowCount: {rowcount(spark, args.path)}")
    elif args.command == "dump" and not args.values:
        for r in dictionaries(spark, args.path, args.columns, args.sample).orderBy("path", "row_group", "column_path", "idx").collect():
            print(f"{r.column_path}[{r.idx}]: {r.value}")
    elif args.command == "dump":
        for r in dump(spark, args.path, args.sample, args.columns).orderBy("column_name", "value").collect():
            print(f"{r.column_name}: {r.value}")
    else:
        for r in footers(spark, args.path, "file").orderBy("path").collect():
            print(f"file: {r.path}\ncreator: {r.created_by}\nversion: {r.format_version}\nrows: {r.num_rows}\nrow groups: {r.num_row_groups}")
        if args.extra:
            for r in footers(spark, args.path, "kv").orderBy("path", "key").collect():
                print(f"extra: {r.key} = {r.value}")
        for r in meta_report(spark, args.path).orderBy("path", "row_group", "column_path").collect():
            stats = f" ST:[min: {r.stats_min}, max: {r.stats_max}, num_nulls: {r.stats_null_count}]" if args.stats else ""
            print(f"{r.column_path}: {r.physical} {r.codec} DO:{r.offset} RC:{r.num_values} SZ:{r.compressed_size}/{r.uncompressed_size}/{r.ratio} ENC:{r.encodings}{stats}")


if __name__ == "__main__":
    main()
