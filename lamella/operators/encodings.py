"""Encodings as relational expressions.

Each works on pages: rows with a page number and a place in the page, so windows never span more
than a page. Every encoder has a decoder, and the two are inverse to one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter

#: Values in a block of delta encoding (fixed value).
DELTA_BLOCK = 128


def paged(df: DataFrame, order: str, rows: int = 1000) -> DataFrame:
    """Adds page and place by a key: pages of `rows` keys, places in key order from 0."""
    df = df.withColumn("page", F.floor(F.col(order) / rows).cast("long"))
    return df.withColumn("place", (F.row_number().over(Window.partitionBy("page").orderBy(order)) - 1).cast("long"))


def run_lengths(df: DataFrame, value: str) -> DataFrame:
    """(page, run, start, value, length): maximal runs of equal values; nulls equal nulls."""
    w = Window.partitionBy("page").orderBy("place")
    fresh = F.when(F.col("place") == 0, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    runs = df.select("page", "place", F.col(value).alias("value"), fresh.alias("_fresh")).withColumn("run", F.sum("_fresh").over(w))
    return runs.groupBy("page", "run").agg(F.min("place").alias("start"), F.first("value").alias("value"), F.count(F.lit(1)).alias("length"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """(page, place, value) of run_lengths' rows."""
    return runs.select("page", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place"), "value")


def pack_bits(df: DataFrame, value: str, width: int) -> DataFrame:
    """(page, word, packed, n): unsigned numbers of 1 to 64 bits, least first, in words of 64 div width values."""
    if not 1 <= width <= 64:
        raise InvalidParameter(f"width {width}")
    per = 64 // width
    low = F.col(value).cast("long").bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))
    shifted = F.call_function("shiftleft", low, F.pmod(F.col("place"), F.lit(per)).cast("int") * width)
    return df.groupBy("page", F.expr(f"place div {per}").alias("word")).agg(F.bit_or(shifted).alias("packed"), F.count(F.lit(1)).cast("int").alias("n"))


def unpack_bits(packed: DataFrame, width: int) -> DataFrame:
    """(page, place, value) of pack_bits' rows; 64 bits are read as a signed number."""
    if not 1 <= width <= 64:
        raise InvalidParameter(f"width {width}")
    per = 64 // width
    rows = packed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    value = F.call_function("shiftrightunsigned", F.col("packed"), F.col("_i") * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))
    return rows.select("page", (F.col("word") * per + F.col("_i")).alias("place"), value.alias("value"))


def bitmap(df: DataFrame, flag: Column) -> DataFrame:
    """(page, byte, bits): booleans eight to a byte, least bit first."""
    bit = F.call_function("shiftleft", flag.cast("int"), F.pmod(F.col("place"), F.lit(8)).cast("int"))
    return df.groupBy("page", F.expr("place div 8").alias("byte")).agg(F.sum(bit).alias("bits"))


def _wrapped(n: Column) -> Column:
    """A whole decimal as the 64-bit number that it equals modulo 2 ** 64."""
    half, whole = (F.lit(str(1 << k)).cast("decimal(38,0)") for k in (63, 64))
    return (F.pmod(n + half, whole) - half).cast("long")


def deltas(df: DataFrame, value: str) -> DataFrame:
    """(page, place, value, delta): differences, modulo 2 ** 64, to the value before in the page; the first has none."""
    w = Window.partitionBy("page").orderBy("place")
    n = F.col(value).cast("decimal(38,0)")
    return df.select("page", "place", F.col(value).alias("value"), _wrapped(n - F.lag(n).over(w)).alias("delta"))


def delta_blocks(df: DataFrame, value: str) -> DataFrame:
    """(page, block, min_delta, bit_width, n): what a delta encoder stores of each block; widths go up to 64."""
    rows = deltas(df, value).withColumn("block", F.expr(f"(place - 1) div {DELTA_BLOCK}")).where("place > 0")
    span = F.max(F.col("delta").cast("decimal(38,0)")) - F.min(F.col("delta").cast("decimal(38,0)"))
    width = F.when(span == 0, 0).otherwise(F.length(F.conv(span.cast("string"), 10, 2))).cast("int")
    return rows.groupBy("page", "block").agg(F.min("delta").alias("min_delta"), width.alias("bit_width"), F.count(F.lit(1)).alias("n"))


def delta_decode(encoded: DataFrame) -> DataFrame:
    """(page, place, value) from rows (page, place, first_value, delta) by a running sum modulo 2 ** 64."""
    w = Window.partitionBy("page").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return encoded.select("page", "place", _wrapped(F.sum(F.coalesce("delta", "first_value").cast("decimal(28,0)")).over(w)).alias("value"))


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """(page, idx, value): a page's distinct values in order, numbered from 0; nulls are left out."""
    distinct = df.where(F.col(value).isNotNull()).groupBy("page", F.col(value).alias("value")).count().drop("count")
    return distinct.withColumn("idx", (F.row_number().over(Window.partitionBy("page").orderBy("value")) - 1).cast("int"))


def dictionary_encode(df: DataFrame, value: str) -> DataFrame:
    """(page, place, idx): each row's number in its page's dictionary."""
    entries = dictionary(df, value)
    return df.select("page", "place", F.col(value).alias("value")).join(entries, ["page", "value"], "left").select("page", "place", "idx")


def dictionary_decode(encoded: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, place, value) from numbers and dictionaries."""
    return encoded.join(entries, ["page", "idx"], "left").select("page", "place", "value")


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two values share at their start: powers of two are added while the longer prefix is still shared."""
    a, b = a.cast("binary"), b.cast("binary")
    most = F.least(F.octet_length(a), F.octet_length(b))

    def longer(n: Column, step: Column) -> Column:
        return F.when((n + step <= most) & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)), n + step).otherwise(n)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(31))]), F.lit(0), longer)


def front_coded(df: DataFrame, value: str) -> DataFrame:
    """(page, place, prefix, suffix): bytes shared with the value before, and the bytes after them, in the value's type.

    A prefix can end inside a character; a string's suffix then begins with the rest of it, so the
    suffix is binary unless the values are ASCII: cast it where they are.
    """
    w = Window.partitionBy("page").orderBy("place")
    coded = F.col(value).cast("binary")
    rows = df.select("page", "place", coded.alias("value"), F.coalesce(F.lag(coded).over(w), F.lit(b"")).alias("_before"))
    rows = rows.withColumn("prefix", common_prefix(F.col("value"), F.col("_before")))
    return rows.select("page", "place", "prefix", F.expr("substring(value, prefix + 1)").alias("suffix"))


def front_decode(coded: DataFrame) -> DataFrame:
    """(page, place, value as binary) from front_coded's rows; a page's values are rebuilt in order, in one row."""
    pages = coded.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("place", "prefix", "suffix"))).alias("x"))
    state = "struct<last:binary,out:array<struct<place:bigint,value:binary>>>"

    def step(s: Column, x: Column) -> Column:
        value = F.concat(F.substring(s["last"], F.lit(1), x["prefix"]), x["suffix"])
        return F.struct(value.alias("last"), F.concat(s["out"], F.array(F.struct(x["place"].cast("bigint").alias("place"), value.alias("value")))).alias("out")).cast(state)

    none = F.struct(F.lit(b"").alias("last"), F.array().cast("array<struct<place:bigint,value:binary>>").alias("out")).cast(state)
    return pages.select("page", F.explode(F.aggregate("x", none, step)["out"]).alias("r")).select("page", "r.place", "r.value")
