"""Split-block bloom filters as aggregations: 256-bit blocks of eight 32-bit words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multipliers of the eight words (fixed values of the file format).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
LOW = 0xFFFFFFFF


def block_of(h: Column, blocks: int) -> Column:
    """The block of a hash: its upper half scaled to the number of blocks."""
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 32) * F.lit(blocks).cast("long"), 32)


def bit_of(h: Column, word: int) -> Column:
    """The bit, 0 to 31, of a hash in a word: the top five bits of a 32-bit product, made of two halves that cannot overflow."""
    low = h.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(SALTS[word]).cast("long")
    high = F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(SALTS[word]).cast("long")
    product = (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)).bitwiseAND(F.lit(LOW).cast("long"))
    return F.shiftrightunsigned(product, 27).cast("int")


def build(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """(block, word, bits) of the words with a bit set; partial unions meet before the shuffle."""
    one = F.lit(1).cast("long")
    words = F.array(*[F.struct(F.lit(i).alias("word"), F.call_function("shiftleft", one, bit_of(F.col(h), i)).alias("bit")) for i in range(8)])
    rows = hashes.where(F.col(h).isNotNull()).select(block_of(F.col(h), blocks).alias("block"), F.explode(words).alias("w"))
    return rows.groupBy("block", F.col("w.word").alias("word")).agg(F.bit_or("w.bit").alias("bits"))


def probe(hashes: DataFrame, h: str, bits: DataFrame, blocks: int) -> DataFrame:
    """Adds maybe: false means certainly absent. Null hashes are absent."""
    by_block = bits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_words"))
    keyed = hashes.withColumn("block", block_of(F.col(h), blocks)).join(by_block, "block", "left")
    one = F.lit(1).cast("long")
    hits = [F.coalesce(F.col("_words")[F.lit(i)].bitwiseAND(F.call_function("shiftleft", one, bit_of(F.col(h), i))) != 0, F.lit(False)) for i in range(8)]
    every = hits[0]
    for x in hits[1:]:
        every = every & x
    return keyed.withColumn("maybe", every).drop("block", "_words")


def words(filters: DataFrame) -> DataFrame:
    """(path, row_group, column_path, block, word, bits) of the filters that files hold (pageindex.filters)."""
    number = F.explode(F.sequence(F.lit(0), F.col("blocks") * 8 - 1))
    rows = filters.select("path", "row_group", "column_path", "bitset", number.alias("_i"))
    digits = F.hex(F.substring("bitset", F.col("_i") * 4 + 1, F.lit(4)))
    swapped = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    bits = F.conv(swapped, 16, 10).cast("long")
    return rows.select("path", "row_group", "column_path", F.expr("_i div 8").cast("long").alias("block"), (F.col("_i") % 8).alias("word"), bits.alias("bits")).where("bits != 0")


def contains(bitset: Column, blocks: Column, h: Column) -> Column:
    """Whether a file's filter may have a hash; false means certainly absent. For pruning row groups by a key."""
    block = F.shiftrightunsigned(F.shiftrightunsigned(h, 32) * blocks.cast("long"), 32)
    every = F.lit(True)
    for i in range(8):
        bit = bit_of(h, i)
        at = block * 32 + 4 * i + F.shiftright(bit, 3) + 1
        byte = F.conv(F.hex(F.substring(bitset, at.cast("int"), F.lit(1))), 16, 10).cast("int")
        every = every & (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)))) != 0)
    return every


def to_bytes(rows: list, blocks: int) -> bytes:
    """The filter as stored in a file, from the collected rows of build."""
    words = [0] * (8 * blocks)
    for r in rows:
        words[8 * r["block"] + r["word"]] = r["bits"]
    return b"".join(w.to_bytes(4, "little") for w in words)
