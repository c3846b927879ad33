"""Payloads stored once by content-defined chunks, and rebuilt from ordered chunk lists.

A rolling gear hash over the last 32 bytes cuts payloads where its upper bits are zero, so equal
passages give equal chunks wherever they stand. A Spark join on the chunk digests names one owner of
each chunk; the store holds, for each distinct payload, a form: a header, its ordered chunk list and
the bytes of the chunks that it owns. Reading fetches the others from their owners and verifies every
digest. media_bytes and media_sha256 are those of the stored form as it was read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, arrow_map, join_facts, release, strings, written

UNIT = 576
FILL = b"\xff"
#: Chunks have 512 to 8,192 bytes, about 2.5 KB on average.
LEAST, MOST, CUT_BITS = 512, 8192, 11
DIGEST = 16
ENTRY = DIGEST + 4
MAGIC = b"LAMCHNK2"
#: A form's header: the magic, the payload's bytes and the number of its chunks.
HEAD = struct.Struct("<8sQI")
#: A 32-bit number for each byte value, by a multiplicative rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(31)).astype(np.uint32)


def payload(text: str) -> bytes:
    """UTF-8, filled with bytes 255 up to a positive multiple of 576."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + FILL * (-len(raw) % UNIT if raw else UNIT)


def cuts(data: bytes) -> list[int]:
    """Where the chunks of a payload end.

    The hash at a byte is the sum of the gear numbers of that byte and the 31 before it, each
    shifted by its distance; doubling the window five times computes it for all bytes at once.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 32:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(width))
        width *= 2
    spots = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, start, n = [], 0, len(data)
    for spot in spots:
        while spot - start > MOST:
            start += MOST
            out.append(start)
        if spot - start >= LEAST and spot < n:
            out.append(spot)
            start = spot
    while n - start > MOST:
        start += MOST
        out.append(start)
    out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def chunk_list(data: bytes) -> tuple[bytes, list[bytes]]:
    """The ordered chunk list (digest and length of each) and the chunks."""
    ends = cuts(data)
    chunks = [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    return b"".join(digest(c) + struct.pack("<I", len(c)) for c in chunks), chunks


def features(data: bytes) -> str:
    """Mean, deviation and entropy of the 8-bit samples."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float((share * np.arange(256)).sum())
    deviation = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    some = share[share > 0]
    return f"mean={mean:.4f};std={deviation:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f}"


def form_of(size: int, chunks: bytes, own: bytes) -> bytes:
    return HEAD.pack(MAGIC, size, len(chunks) // ENTRY) + chunks + own


def parsed(form: bytes) -> tuple[int, list[tuple[bytes, int]], bytes]:
    """The payload's bytes, the chunk list and the owned bytes of a form."""
    magic, size, n = HEAD.unpack_from(form)
    if magic != MAGIC:
        raise ValueError("no stored payload")
    end = HEAD.size + n * ENTRY
    return size, list(struct.iter_unpack(f"<{DIGEST}sI", form[HEAD.size : end])), form[end:]


def _lists(docs: DataFrame) -> DataFrame:
    def make():
        def each(batch):
            out = []
            for x in strings(batch, "text"):
                data = payload(x)
                out.append((len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")), len(data), chunk_list(data)[0]))
            kept = batch.select(["doc_id", "text_key"]).columns
            kinds = (pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([*kept, *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], ["doc_id", "text_key", "n_bytes", "payload_bytes", "chunks"])

        return each

    return arrow_map(docs.select("doc_id", "text_key", "text"), make, "doc_id long, text_key binary, n_bytes long, payload_bytes long, chunks binary")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=6)

        def each(batch):
            kept = batch.select(["doc_id", "text_key"]).columns
            return pa.record_batch([*kept, pa.array([pack.compress(payload(x)) for x in strings(batch, "text")], pa.binary())], ["doc_id", "text_key", "z"])

        return each

    return arrow_map(docs.select("doc_id", "text_key", "text"), make, "doc_id long, text_key binary, z binary")


def store(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the store; returns doc_id, text_key, n_bytes of every row, and text_key, rep, n of every distinct text.

    The store has a row for each distinct text: rep, form, owners and places (rep and place of each
    chunk's owner; null where all are its own first ones), shared (owned chunks that others refer to).
    The least hash of the text's digest owns a chunk, so a text's form does not depend on the run.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.unhex(F.sha2(value.cast("binary"), 256)).alias("text_key"), value.alias("text"))
    lists = written(_lists(source), "lists")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunks")).alias("one")
    reps = lists.groupBy("text_key").agg(one, F.count(F.lit(1)).alias("n")).select("text_key", "n", F.monotonically_increasing_id().alias("rep"), F.col("one.doc_id").alias("doc_id"), F.col("one.chunks").alias("chunks"))
    reps = written(reps, "reps")
    release(spark)

    places = reps.select("rep", F.xxhash64("text_key").alias("order"), "chunks", F.explode(F.sequence(F.lit(0), (F.length("chunks") / ENTRY).cast("int") - 1)).alias("place"))
    places = places.select("rep", "order", "place", F.expr(f"substring(chunks, place * {ENTRY} + 1, {DIGEST})").alias("digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("order", "rep", "place")).alias("owner"), F.count(F.lit(1)).alias("uses"))
    # Only a chunk that is used more than once has another owner than its own place; the others need no join.
    owners = written(owners.where("uses > 1"), "owners")
    uses = owners.agg(F.sum("uses")).first()[0] or 0
    found = join_facts(places.select("rep", "place", "digest"), owners, ["digest"], "uses", uses)
    found = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", F.col("owner.rep").alias("owner"), F.col("owner.place").alias("at")))).alias("owners"))
    flagged = written(reps.select("rep", "doc_id", "text_key", "chunks").join(found, "rep", "left"), "flagged")
    release(spark)

    wanted = flagged.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    packed = _packed(source)
    match = [packed["text_key"] == wanted["_key"], F.coalesce(packed["doc_id"], F.lit(0)) == F.coalesce(wanted["_doc"], F.lit(0)), packed["doc_id"].eqNullSafe(wanted["_doc"])]
    joined = packed.join(wanted, match).select("rep", "z", "chunks", "owners")

    def make():
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def each(batch):
            out = []
            for rep, z, chunks, known in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rep", "z", "chunks", "owners"))):
                data = unpack.decompress(z)
                of = {x["place"]: (x["owner"], x["at"]) for x in known or ()}
                own, at, owners, shared = [], 0, [], []
                for i, (size,) in enumerate(struct.iter_unpack(f"<{DIGEST}xI", chunks)):
                    owner = of.get(i, (rep, i))
                    owners.append(owner)
                    shared.append(i in of and owner == (rep, i))
                    if owner == (rep, i):
                        own.append(data[at : at + size])
                    at += size
                foreign = any(x != (rep, i) for i, x in enumerate(owners))
                out.append((rep, form_of(len(data), chunks, b"".join(own)), [x for x, _ in owners] if foreign else None, [x for _, x in owners] if foreign else None, shared if any(shared) else None))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["rep", "form", "owners", "places", "shared"])

        return each

    rows = arrow_map(joined, make, "rep long, form binary, owners array<long>, places array<int>, shared array<boolean>")
    # Rows that repeat an id and a text meet here with one rep; one of them is enough.
    repeated = not lists.groupBy("text_key", "doc_id").count().where("count > 1").isEmpty()
    (rows.dropDuplicates(["rep"]) if repeated else rows).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
    release(spark)
    return lists.select("doc_id", "text_key", "n_bytes"), reps.select("text_key", "rep", "n")


def _exports(stored: DataFrame) -> DataFrame:
    """(owner, at, bytes) of the chunks that other rows refer to."""

    def make():
        def each(batch):
            out: list[tuple] = []
            for rep, form, owners, places, shared in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rep", "form", "owners", "places", "shared"))):
                at = 0
                _, entries, own = parsed(form)
                for i, (_, size) in enumerate(entries):
                    if owners is None or (owners[i], places[i]) == (rep, i):
                        if shared[i]:
                            out.append((rep, i, own[at : at + size]))
                        at += size
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], ["owner", "at", "bytes"]) if out else None

        return each

    return arrow_map(stored.where("shared is not null"), make, "owner long, at int, bytes binary")


READ = "rep long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks int, feature string"


def _rebuilt(rows: DataFrame) -> DataFrame:
    """Payloads from own and fetched chunks, each verified by its digest."""

    def make():
        def each(batch):
            out = []
            names = ("rep", "form", "owners", "places", "fetched")
            for rep, form, owners, places, fetched in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                got = {(x["owner"], x["at"]): x["bytes"] for x in fetched or ()}
                parts, at = [], 0
                whole, entries, own = parsed(form)
                for i, (want, size) in enumerate(entries):
                    if owners is None or (owners[i], places[i]) == (rep, i):
                        part = own[at : at + size]
                        at += size
                    else:  # a payload's own earlier chunk, or another's
                        part = parts[places[i]] if owners[i] == rep else got[owners[i], places[i]]
                    if len(part) != size or digest(part) != want:
                        raise ValueError(f"chunk {i} of payload {rep} does not match its digest")
                    parts.append(part)
                data = b"".join(parts)
                if len(data) != whole:
                    raise ValueError(f"payload {rep} has not the stored size")
                out.append((rep, whole, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(form), hashlib.sha256(form).hexdigest(), len(entries), features(data)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in READ.split(", ")])

        return each

    return arrow_map(rows.select("rep", "form", "owners", "places", "fetched"), make, READ)


def read(spark, path: str, only: DataFrame | None = None) -> DataFrame:
    """One row per distinct text (only: those of a small table of reps), computed from the stored bytes alone."""
    stored = spark.read.parquet(path)
    asking = stored if only is None else stored.join(F.broadcast(only), "rep", "left_semi")
    fetched = "array<struct<owner:bigint,at:int,bytes:binary>>"
    alone = asking.where("owners is null").withColumn("fetched", F.lit(None).cast(fetched))
    others = asking.where("owners is not null")
    asked = others.select("rep", F.explode(F.array_distinct(F.arrays_zip(F.col("owners").alias("owner"), F.col("places").alias("at")))).alias("x"))
    asked = asked.select("rep", F.col("x.owner").alias("owner"), F.col("x.at").alias("at")).where("owner != rep")
    sent = asked.join(_exports(stored), ["owner", "at"]).groupBy("rep").agg(F.collect_list(F.struct("owner", "at", "bytes")).alias("fetched"))
    return _rebuilt(alone).unionByName(_rebuilt(others.join(sent, "rep", "left")))


def media(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores all payloads below path and returns what is read back, a row for every input row.

    Null texts count as empty: their payload is 576 bytes 255. Equal texts have equal values. The id
    must be a whole number or null; other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    lists, reps = store(docs, path, id, text)
    # Texts with very many rows, fewer than HOT_KEYS of them, are read apart and sent to where their rows are.
    least = lists.count() // HOT_KEYS
    hot = reps.where(F.col("n") > least).select("text_key", "rep")
    cold = lists.join(F.broadcast(hot.select("text_key")), "text_key", "left_anti").join(reps.where(F.col("n") <= least).select("text_key", "rep"), "text_key").join(read(spark, path), "rep")
    if hot.isEmpty():
        return cold.drop("rep", "text_key")
    some = hot.join(read(spark, path, hot.select("rep")), "rep")
    return lists.join(F.broadcast(some), "text_key").unionByName(cold).drop("rep", "text_key")
