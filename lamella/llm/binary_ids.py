"""Token ids in binary segments with Elias-Fano coded document boundaries.

A segment holds the ids of consecutive documents (by ascending doc_id) one after another, and the
place where each begins as an Elias-Fano sequence: the low bits packed, the high bits in unary, and
a running count of ones before every 512 bits, which makes select(i) local. Segments are binary
columns of a Parquet table, so that any store Spark writes to can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, encoder

#: A segment ends when it has so many ids or documents.
SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 12
SUPER = 512
#: Shards at most: percentile_approx then tells their cuts well apart, and a shard is a stream of any length.
MOST_SHARDS = 1 << 13


class EliasFano:
    """A non-decreasing sequence of n numbers from 0 to u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, u: int, bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.u, self.bits, self.low, self.high, self.ranks = n, u, bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray, u: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(u // n).bit_length() - 1) if n else 0
        lows = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1) if bits else np.zeros((n, 0), np.uint64)
        low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little")
        marks = np.zeros(n + (int(u) >> bits) + 1, np.uint8)
        marks[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, int(u), bits, low, np.packbits(marks, bitorder="little"), cls.counted(marks))

    @staticmethod
    def counted(marks: np.ndarray) -> np.ndarray:
        """Ones before each stretch of SUPER bits."""
        padded = np.append(marks, np.zeros(-len(marks) % SUPER, np.uint8))
        return np.concatenate(([0], np.cumsum(padded.reshape(-1, SUPER).sum(1, dtype=np.uint32))))[:-1].astype("<u4")

    def to_bytes(self) -> bytes:
        head = struct.pack("<IQBIII", self.n, self.u, self.bits, len(self.low), len(self.high), len(self.ranks))
        return head + self.low.tobytes() + self.high.tobytes() + self.ranks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, u, bits, a, b, c = struct.unpack_from("<IQBIII", raw)
        at = struct.calcsize("<IQBIII")
        low, high = np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, u, bits, low, high, np.frombuffer(raw, "<u4", c, at + a + b))

    def select(self, wanted: np.ndarray | int) -> np.ndarray | int:
        """The numbers at the wanted places: of the unary part only the stretches that hold them are read."""
        i = np.atleast_1d(np.asarray(wanted, np.int64))
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(wanted)
        stretch = np.searchsorted(self.ranks, i, "right") - 1
        some, place = np.unique(stretch, return_inverse=True)
        bytes_of = some[:, None] * (SUPER // 8) + np.arange(SUPER // 8)
        bits = np.unpackbits(np.where(bytes_of < len(self.high), self.high[np.minimum(bytes_of, len(self.high) - 1)], 0).astype(np.uint8), axis=1, bitorder="little")
        row, column = np.nonzero(bits)
        first = np.searchsorted(row, np.arange(len(some)))
        found = column[first[place] + i - self.ranks[stretch].astype(np.int64)]
        out = (stretch * SUPER + found - i) << self.bits
        if self.bits:
            at = i[:, None] * self.bits + np.arange(self.bits)
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        return out if np.ndim(wanted) else int(out[0])

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        highs = (ones - np.arange(self.n)).astype(np.int64) << self.bits
        if not self.bits:
            return highs
        lows = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits)
        return highs | (lows.astype(np.int64) << np.arange(self.bits)).sum(1)


def _segments(rows: Iterator[tuple[int | None, bytes]], width: int) -> Iterator[tuple]:
    keys: list[int | None] = []
    parts: list[bytes] = []
    size = 0

    def closed() -> tuple:
        starts = np.concatenate(([0], np.cumsum([len(p) // width for p in parts])))
        edges = EliasFano.of(starts, int(starts[-1]))
        return list(keys), edges.to_bytes(), b"".join(parts), int(starts[-1])

    for key, raw in rows:
        if parts and (size + len(raw) // width > SEGMENT_IDS or len(parts) == SEGMENT_DOCS):
            yield closed()
            keys.clear(), parts.clear()
            size = 0
        keys.append(key)
        parts.append(raw)
        size += len(raw) // width
    if parts:
        yield closed()


def _number(key: Column, edges: list[int]) -> Column:
    """How many of the ascending edges the key reaches (null: none), found in two steps of a square root each."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    every = F.expr(f"array({', '.join(f'{x}L' for x in edges)})")
    heads = F.expr(f"array({', '.join(f'{x}L' for x in edges[::step])})")
    head = F.greatest(F.size(F.filter(heads, lambda x: x <= key)) - 1, F.lit(0)) * step
    return F.coalesce(head + F.size(F.filter(F.slice(every, head + 1, F.lit(step)), lambda x: x <= key)), F.lit(0))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text") -> None:
    """Writes segments in ascending order of id (nulls first): shard, segment, keys, edges, ids, n_ids, width.

    Shards are ranges of the id, cut at its approximate quantiles, which one pass over that column
    finds; a shard's rows are sorted and encoded as a stream. Each document ends with end_id; null and
    empty texts have that alone. Rows that repeat an id follow one another. The id must be a whole
    number or null; other columns are left out. An empty table writes no segment.
    """
    spark = docs.sparkSession
    shards = min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    key = F.col(id).cast("long")
    cuts = docs.select(F.percentile_approx(key, F.array(*[F.lit(i / shards) for i in range(1, shards)]), 8 * MOST_SHARDS).alias("q")).first()["q"] if shards > 1 else None
    edges = sorted(set(cuts or []))
    rows = docs.select(key.alias("doc_id"), F.col(text).alias("text"), _number(key, edges).alias("shard"))
    ranged = rows.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        enc = encoder(tokenizer)
        last = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        shard = [0]

        def docs_of():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    shard[0] = part.column(2)[0].as_py()
                    for key, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        yield key, enc.packed(x or "") + last

        for segment, (keys, edges, ids, n) in enumerate(_segments(docs_of(), width)):
            yield pa.record_batch(
                [pa.array([shard[0]], pa.int32()), pa.array([segment], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([edges], pa.binary()), pa.array([ids], pa.binary()), pa.array([n], pa.int64()), pa.array([width], pa.int32())],
                ["shard", "segment", "keys", "edges", "ids", "n_ids", "width"],
            )

    schema = "shard int, segment int, keys array<long>, edges binary, ids binary, n_ids long, width int"
    ranged.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back: doc_id, start, n_tokens, ids_crc32, shard, segment, place.

    start counts the ids of all documents before it; the crc is of little-endian unsigned 32-bit ids.
    """
    stored = spark.read.parquet(path)
    sizes = stored.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))
    earlier = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base")).join(shards, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, segment, keys, raw, ids, width = (batch.column(i)[row].as_py() for i in range(6))
                n = len(keys)
                starts = EliasFano.from_bytes(raw).select(np.arange(n + 1))
                values = np.frombuffer(ids, f"<u{width}")
                sums = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.record_batch(
                    [pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64())],
                    ["shard", "segment", "place", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    decoded = stored.select("shard", "segment", "keys", "edges", "ids", "width").mapInArrow(run, "shard int, segment int, place int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return decoded.join(bases, ["shard", "segment"]).select("doc_id", (F.col("shard_base") + F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment", "place")
