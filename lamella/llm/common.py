"""What the text operators share: scratch tables, Arrow maps and memoised encoders."""

from __future__ import annotations

import atexit
import ctypes
import gc
import json
import os
import re
import shutil
import sys
import time
import uuid
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakSet

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

#: Bytes that a memo may take, both generations together, as reckoned here (about a third is less in
#: fact): of an encoder's chunks between spaces, and of any other; an operator has one to three.
CHUNK_BYTES, MEMO_BYTES = 320 << 20, 24 << 20
#: Bytes of a memo's entry besides its key and value, roughly.
ENTRY_BYTES = 110
#: Rows handled at once within an Arrow batch, and their bytes on average, so that long texts do not pile up.
ROWS_AT_ONCE, BYTES_AT_ONCE = 128, 2 << 20
#: A key is hot that holds more than one in so many of all rows: there are fewer such keys than this.
HOT_KEYS = 4096
LITTLE = sys.byteorder == "little"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_bases: dict[str, str] = {}


def scratch_base(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share.

    In local mode a local folder is set where the setting is absent; on a cluster that is an error,
    since each machine would write to a folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _bases:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file:///tmp/checkpoints/lamella"
            spark.sparkContext.setCheckpointDir(base)
        _bases[app] = f"{base.rstrip('/')}/lamella-{app}"
        atexit.register(drop_scratch, spark, app)
    return _bases[app]


_made: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for some in _made[-1:]:
        some.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Drops the scratch folders that are made inside, when it ends."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def drop_scratch(spark: SparkSession, app: str | None = None) -> None:
    """Deletes an application's scratch tables; their DataFrames can no longer be read.

    After the session's end only a folder of the local mode can still be deleted.
    """
    base = _bases.pop(app or spark.sparkContext.applicationId, None)
    if base is None:
        return
    try:
        drop(spark, base)
    except (Py4JError, OSError, AttributeError):  # the JVM has ended
        if base.startswith("file:///"):
            shutil.rmtree(base[7:], ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut, work is done once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop shuffle files of finished steps: it acts on the driver's GC."""
    for _ in range(2):  # Python's proxies let go of the JVM's objects a moment after the first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def without_dropped(docs: DataFrame, decided: DataFrame, id: str, text: str, key: Column) -> DataFrame:
    """The documents whose rows are kept, with all their columns.

    decided: doc_id, key, kept, a row for each document; `key` is the same function of the text over
    docs. Where rows repeat both, and some are kept, one of them stays.
    """
    kept = decided.where("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    gone = decided.where("not kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    both = gone.select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"))
    repeats = kept.join(both, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2"))).select("_id", "_key")

    def match(some: DataFrame) -> Column:
        return docs[id].eqNullSafe(some["_id"]) & (key == some["_key"])

    left = docs.join(gone, match(gone), "left_anti")
    if repeats.isEmpty():
        return left
    return left.unionByName(docs.join(repeats, match(repeats), "left_semi").dropDuplicates([id, text]))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS_AT_ONCE rows, fewer where rows are long."""
    step = max(1, min(ROWS_AT_ONCE, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


_owner: list[str | None] = [None]


def claim(owner: str) -> None:
    """Frees what another operator left in this worker, which Spark uses again: memos, encoders, free pages."""
    if _owner[0] != owner:
        _owner[0] = owner
        for memo in list(_memos):
            memo.forget()
        _encoders.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow over slices of the batches; make() runs once a task."""
    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        each = make()
        for batch in batches:
            for part in slices(batch):
                out = each(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with the one row that facts have for each key; `size` counts a key's rows, `total` all.

    Keys with more than total / HOT_KEYS rows are fewer than HOT_KEYS whatever the input, so their
    facts are broadcast and their rows stay where they are; no other key is large enough to matter
    to a shuffle. Both tables are read twice, so they should be written ones.
    """
    least = total // HOT_KEYS
    hot = F.broadcast(facts.where(F.col(size) > least))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col(size) <= least), keys)
    return rows.join(hot, keys).unionByName(cold)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Memo(dict):
    """A dict that fills itself by a function and forgets by bytes.

    When its entries take half of `most` bytes they become the older generation, and the older ones
    are dropped; an older entry that is asked for again is young again. Frequent keys stay, and one
    text of any length cannot make it grow beyond its bound.
    """

    __hash__, __eq__ = object.__hash__, object.__eq__

    def __init__(self, make: Callable, most: int | None = None):
        super().__init__()
        self.make, self.most = make, most or MEMO_BYTES
        self.older: dict = {}
        self.used = 0
        _memos.add(self)

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        self.used += ENTRY_BYTES + sys.getsizeof(key) + sys.getsizeof(value)
        if 2 * self.used > self.most:
            self.older = dict(self)
            self.clear()
            self.used = 0
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older, self.used = {}, 0


_memos: WeakSet[Memo] = WeakSet()


#: Letters and digits of ASCII and Latin-1 by Unicode category (fixed values).
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
DIGIT = "0-9²³¹¼-¾"
#: Texts of these characters alone are split here; any other goes whole to the library.
PLAIN = re.compile(r"[\t\n\r -~¡-ÿ]*")
BYTE_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
WORD_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")
#: Byte-level alphabet: bytes that print in Latin-1 are themselves, the others follow from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


class Encoder:
    """Ids of a text by a tokenizers file, as packed little-endian bytes.

    Both known layouts split a text into pieces that are encoded independently, so the ids of a
    piece are remembered, and a new piece goes to the library's merging model alone. Splitting
    follows the file's own pattern for plain Latin text; any other text, and any other layout, is
    encoded whole by the library, as is a text that holds one of the file's added tokens, in any case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        def state(part) -> dict:
            return json.loads(part.__getstate__()) if part is not None else {}

        normalizers = [x["type"] for x in state(self.library.normalizer).get("normalizers", [])]
        pre = state(self.library.pre_tokenizer)
        if self.library.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.packed = self._byte_level
        elif normalizers == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.packed = self._words
        else:
            self.packed = self._whole
        contents = sorted({x.content.lower() for x in self.library.get_added_tokens_decoder().values()})
        self.added = re.compile("|".join(map(re.escape, contents)), re.IGNORECASE) if contents else None
        start = os.path.commonprefix(contents)
        #: Signs with which every added token begins; a text without them needs no search for the tokens.
        self.sign = start if start == start.upper() else ""
        self.chunks = Memo(self._spaced if self.packed == self._byte_level else self._chunk, CHUNK_BYTES)
        self.bare = Memo(self._piece)

    def _little(self, ids: list[int]) -> bytes:
        values = array(self.dtype.char, ids)
        return values.tobytes() if LITTLE else values.byteswap() or values.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._little(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # these are themselves in the byte-level alphabet, but for the space
            shown = piece.replace(" ", ALPHABET[32])
        else:
            shown = piece.encode().decode("latin-1").translate(ALPHABET)
        return self._little([x.id for x in self.model.tokenize(shown)])

    def _spaced(self, chunk: str) -> bytes:
        """Of a chunk with a space before it."""
        found = BYTE_PIECE.findall(" " + chunk)
        if len(found) == 1:
            return self._piece(" " + chunk)
        return b"".join([self.chunks[p[1:]] if p[0] == " " and len(p) > 1 else self.bare[p] for p in found])

    def _chunk(self, chunk: str) -> bytes:
        found = WORD_PIECE.findall(chunk)
        return self._piece(chunk) if found == [chunk] else b"".join(map(self.chunks.__getitem__, found))

    def _odd(self, text: str) -> bool:
        """Whether only the library splits the text right."""
        return not PLAIN.fullmatch(text) or (self.added is not None and self.sign in text and self.added.search(text) is not None)

    def _byte_level(self, text: str) -> bytes:
        if self._odd(text):
            return self._whole(text)
        if "  " in text:
            return b"".join([self.chunks[p[1:]] if p[0] == " " and len(p) > 1 else self.bare[p] for p in BYTE_PIECE.findall(text)])
        first, space, rest = text.partition(" ")
        head = b"".join(map(self.bare.__getitem__, BYTE_PIECE.findall(first)))
        return head + b"".join(map(self.chunks.__getitem__, rest.split(" "))) if space else head

    def _words(self, text: str) -> bytes:
        if self._odd(text):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
