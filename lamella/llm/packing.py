"""Best-fit packing by matching large items first.

Lengths are whole numbers up to the capacity, so a histogram of them, whose size the capacity
bounds, is all that the choice of bins needs. Items over a third of the capacity are matched at most
two a bin, each with the largest partner that fits; smaller items then go, largest first, where the
least room remains. Equal lengths are placed in runs, and each item finds its place from its rank
among the items of its length.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, encoder, strings, written

#: Rows of one length that a ranking task gets, roughly: a length with more is divided by salts.
ROWS_PER_SALT = 2_000


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece of at most `capacity` ids: doc_id, piece, start, length, ids_crc32.

    Every document ends with end_id, so empty and null texts have one piece of one id. Only
    documents beyond the capacity are cut. With ids=True the column ids has them as little-endian
    unsigned 32-bit numbers. The id must be a whole number or null; other columns are left out.
    """
    schema = PIECE + ", ids binary" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        enc = encoder(tokenizer)

        def each(batch):
            keys = batch.column(batch.schema.get_field_index(id)).to_pylist()
            out: list[list] = [[] for _ in names]
            for key, x in zip(keys, strings(batch, text)):
                found = np.append(enc.ids(x).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(found), capacity)):
                    raw = found[start : start + capacity].tobytes()
                    for column, value in zip(out, (key, piece, start, len(raw) // 4, zlib.crc32(raw), raw)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names)

        return each

    return arrow_map(docs.select(F.col(id).cast("long").alias(id), text), make, schema)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, items, first bin, items per bin, first offset) that place every item.

    Item number r of a run sits in bin `first bin + r div per_bin` at offset
    `first offset + (r mod per_bin) * length`. An item beyond the capacity has a bin of its own.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {k: n for k, n in histogram.items() if k > 0 and n > 0}
    used = {k: 0 for k in left}
    bins = 0
    rooms: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def free(room: int, first: int, n: int) -> None:
        if n and room > 0:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((first, n))

    def place(length: int, n: int, first: int, per_bin: int, offset: int) -> None:
        runs.append((length, used[length], n, first, per_bin, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            n = left[a]
            place(a, n, bins, 1, 0)
            free(capacity - a, bins, n)
        elif b == a:
            n = left[a] // 2
            if n:
                place(a, 2 * n, bins, 2, 0)
                free(capacity - 2 * a, bins, n)
                bins += n
            if left[a]:
                if at > 0:
                    # the odd one goes with the next smaller length
                    b, n = large[at - 1], 1
                    place(a, 1, bins, 1, 0)
                    place(b, 1, bins, 1, a)
                    free(capacity - a - b, bins, 1)
                else:
                    n = 1
                    place(a, 1, bins, 1, 0)
                    free(capacity - a, bins, 1)
            else:
                n = 0
        else:
            n = min(left[a], left[b])
            place(a, n, bins, 1, 0)
            place(b, n, bins, 1, a)
            free(capacity - a - b, bins, n)
        bins += n
        large = [k for k in large if left[k]]

    small = [-k for k in left if left[k]]
    heapq.heapify(small)
    while small:
        s = -heapq.heappop(small)
        while left[s]:
            at = bisect_left(sizes, s)
            if at == len(sizes):
                n = -(-left[s] // (capacity // s))
                free(capacity, bins, n)
                bins += n
                continue
            room = sizes[at]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                sizes.pop(at)
            k = room // s
            full = min(n, left[s] // k)
            if full:
                place(s, full * k, first, k, capacity - room)
                free(room - k * s, first, full)
            if full < n and 0 < left[s] < k:
                part = left[s]
                place(s, part, first + full, part, capacity - room)
                free(room - part * s, first + full, 1)
                full += 1
            free(room, first + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 6)


def pack(items: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The items with sequence_id and offset: bins of at most `capacity`, gapless from 0.

    Repeated rows are items of their own. A length of null, zero or less takes no room: both new
    columns are null. A length beyond the capacity fills a bin alone. `items` should be a written
    table: it is read twice. The histogram has at most `capacity` + 1 rows that matter.
    """
    taken = F.least(F.col(length), F.lit(capacity + 1))
    k = F.when(F.col(length) > 0, taken).otherwise(0).cast("long")
    counts = {r["k"]: r["count"] for r in items.groupBy(k.alias("k")).count().collect()}
    histogram = {n: counts[n] for n in counts if n}
    runs = plan(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    # A row for each length that occurs, so at most capacity + 2: small at any size of input.
    salts = F.broadcast(items.sparkSession.createDataFrame([(n, 1 + counts[n] // ROWS_PER_SALT) for n in sorted(counts)], "_k long, _salts long"))
    keyed = items.withColumn("_k", k).join(salts, "_k")
    keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts"))).drop("_salts")
    sums = keyed.groupBy("_k", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_k", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_k", "_salt").orderBy(*order)
    ranked = keyed.withColumn("_in", F.row_number().over(within)).join(bases, ["_k", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_in") - 1)
    starts = runs[:, 0] * (1 << 44) + runs[:, 1]
    names = items.columns

    def make():
        def each(batch):
            k, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_k", "_rank"))
            at = np.maximum(np.searchsorted(starts, k * (1 << 44) + rank, "right") - 1, 0)
            none = k == 0
            if len(runs):
                _, r0, _, first, per, offset = runs[at].T
                sequence, place = first + (rank - r0) // per, offset + (rank - r0) % per * k
            else:
                sequence, place = np.zeros_like(k), np.zeros_like(k)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            return pa.record_batch([*kept, pa.array(sequence, mask=none), pa.array(place, mask=none)], [*names, "sequence_id", "offset"])

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return arrow_map(ranked.select(*names, "_k", "_rank"), make, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The documents' pieces in sequences of at most `capacity` ids, without the ids themselves.

    Columns of docs other than doc_id and text are left out. An empty table gives no rows.
    """
    return pack(written(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
