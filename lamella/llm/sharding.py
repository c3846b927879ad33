"""Sharding by extendible hashing, in DataFrame operations.

A document's shard is a prefix of its hash. The directory starts from a histogram of bytes over the
first TOP_BITS bits, whose size is fixed, so its upper part is settled by the driver; only prefixes
that hold more than the limit are split on further bits, by sums that are dealt by prefix.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_facts, written

HASH_BITS = 60
#: Bits of the part of the directory that the driver holds: at most 4,096 cells.
TOP_BITS = 12
#: Bits by which prefixes that are still too large are split in each further round.
MORE_BITS = 4
#: Parts and rows that a block of a hot hash holds, roughly.
PARTS_A_BLOCK, ROWS_A_BLOCK = 64, 65_536


def hashed(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(bits: Column | int, of: str = "h") -> Column:
    return F.call_function("shiftright", F.col(of), F.lit(HASH_BITS) - bits if isinstance(bits, Column) else F.lit(HASH_BITS - bits))


def _parts(rest: DataFrame, limit_bytes: int) -> DataFrame:
    """Adds depth, node, part, shard_bytes and shard_docs to rows whose hashes exceed the limit alone.

    The rows of a hash are dealt to blocks at random, and each block is cut on its own: a part closes
    before the row that would pass the limit. The blocks' counts of parts, summed up, number them.
    """
    rest = written(rest, "rest")
    blocks = F.greatest(F.ceil(F.sum("n_bytes") / F.lit(PARTS_A_BLOCK * limit_bytes)), F.ceil(F.count(F.lit(1)) / F.lit(ROWS_A_BLOCK)))
    sized = written(rest.groupBy("h").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")), "sized")
    dealt = join_facts(rest, sized, ["h"], "n", rest.count())
    dealt = written(dealt.withColumn("block", F.floor(F.rand(7) * F.col("blocks")).cast("long")).drop("blocks", "n"), "dealt")

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("n_bytes")
        part, used, of = 0, 0, []
        for n in table["n_bytes"].to_pylist():
            if of and of[-1] == part and used + n > limit_bytes:
                part, used = part + 1, 0
            used += n
            of.append(part)
        sizes = np.zeros(part + 1, np.int64)
        np.add.at(sizes, of, table["n_bytes"].to_numpy())
        out = {"part": np.array(of, np.int64), "shard_bytes": sizes[of], "shard_docs": np.bincount(of).astype(np.int64)[of]}
        for name, values in out.items():
            table = table.append_column(name, pa.array(values))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    done = written(dealt.groupBy("h", "block").applyInArrow(cut, f"{schema}, part long, shard_bytes long, shard_docs long"), "parts")
    before = Window.partitionBy("h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = done.groupBy("h", "block").agg((F.max("part") + 1).alias("parts"))
    first = counts.select("h", "block", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("first"))
    numbered = done.join(first, ["h", "block"])
    return numbered.withColumn("part", F.col("part") + F.col("first")).drop("first", "block").withColumn("depth", F.lit(HASH_BITS)).withColumn("node", F.col("h"))


def _top(rows: DataFrame, limit_bytes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, depth, node, shard_bytes, shard_docs) of the cells of TOP_BITS bits whose shard needs no further bit."""
    counted = rows.groupBy(prefix(TOP_BITS).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    cells = {r["cell"]: (r["b"], r["n"]) for r in counted}
    leaves, too_large = [], {0: list(cells)}
    for depth in range(TOP_BITS + 1):
        split: dict[int, list[int]] = {}
        for node, some in too_large.items():
            size, docs = (sum(cells[c][i] for c in some) for i in (0, 1))
            if size <= limit_bytes or docs <= 1:
                leaves += [(c, depth, node, size, docs) for c in some]
            elif depth < TOP_BITS:
                for c in some:
                    split.setdefault(c >> (TOP_BITS - depth - 1), []).append(c)
        too_large = split
    return leaves


def assign(docs: DataFrame, limit_bytes: int, id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, oversized for every row.

    shard is the prefix in binary digits (the empty prefix: "-"), with a part number after a dot
    where rows of one and the same hash exceed the limit together. A document larger than the limit
    has a shard of its own, marked oversized. Null and empty texts have no bytes; null ids hash as
    the empty text. The column `row`, where one is named, is kept as _row; others are left out. An
    empty table gives no rows.
    """
    kept = [] if row is None else [F.col(row).alias("_row")]
    rows = written(docs.select(*kept, F.col(id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), hashed(F.col(id)).alias("h")), "hashed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top = F.broadcast(docs.sparkSession.createDataFrame(_top(rows, limit_bytes), "cell long, depth int, node long, shard_bytes long, shard_docs long"))
    keyed = rows.withColumn("cell", prefix(TOP_BITS))
    found = [keyed.join(top, "cell").withColumn("part", F.lit(0)).drop("cell")]
    rest = keyed.join(F.broadcast(top.select("cell")), "cell", "left_anti").drop("cell")
    low, high = TOP_BITS + 1, min(HASH_BITS, max(TOP_BITS, math.ceil(math.log2(max(1, total / limit_bytes)))) + 3)
    while not rest.isEmpty():
        if low > HASH_BITS:
            found.append(_parts(rest, limit_bytes))
            break
        rest = written(rest, "oversized")
        cells = rest.groupBy(prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        depths = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("node", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
        nodes = depths.groupBy("depth", "node").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") <= 1)
        leaf = depths.select("cell", "depth", "node").join(nodes.where(fits), ["depth", "node"]).groupBy("cell").agg(F.min(F.struct("depth", "node", "shard_bytes", "shard_docs")).alias("leaf"))
        leaf = written(leaf.select("cell", "leaf.*"), "directory")
        keyed = rest.withColumn("cell", prefix(high))
        found.append(keyed.join(leaf, "cell").withColumn("part", F.lit(0)).drop("cell"))
        rest = keyed.join(leaf, "cell", "left_anti").drop("cell")
        low, high = high + 1, min(HASH_BITS, high + MORE_BITS)
    digits = F.when(F.col("depth") == 0, F.lit("-")).otherwise(F.lpad(F.bin("node"), F.col("depth"), F.lit("0")))
    return reduce(DataFrame.unionByName, found).select(
        "doc_id",
        "n_bytes",
        F.when(F.col("part") == 0, digits).otherwise(F.concat_ws(".", digits, F.col("part").cast("string"))).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        "shard_bytes",
        "shard_docs",
        (F.col("shard_bytes") > limit_bytes).alias("oversized"),
        *(["_row"] if kept else []),
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id: str = "doc_id", text: str = "text") -> str:
    """Writes the documents with a folder for each shard; returns the name of the folders' column.

    The name is "shard", with underscores after it where the documents have such a column. A folder's
    name is an h and the shard, so that reading infers a string and no number.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    number = "_row"
    while number in docs.columns:
        number += "_"
    # Numbers are written with the rows, so rows of one id can go to different shards.
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    where = assign(numbered, limit_bytes, id, text, number).select(F.col("_row").alias("_of"), F.concat(F.lit("h"), F.col("shard")).alias(name))
    numbered.join(where, numbered[number] == where["_of"]).select(*[numbered[f"`{c}`"] for c in docs.columns], where[name]).write.partitionBy(name).parquet(path)
    return name
