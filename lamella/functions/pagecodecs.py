"""Pages of values as arrays: levels split off, plain, dictionary and delta encodings decoded."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa

from ..errors import FeatureNotSupported, OutOfSpec
from . import bytecodecs

#: Bytes of a value by physical type (fixed values of the file format).
SIZES = {"INT32": 4, "INT64": 8, "INT96": 12, "FLOAT": 4, "DOUBLE": 8}
DTYPES = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}


def split_v1(body: bytes, max_def: int, max_rep: int) -> tuple[bytes, bytes, bytes]:
    """(repetition levels, definition levels, values): each kind of level is led by its size in four bytes."""
    parts, at = [], 0
    for most in (max_rep, max_def):
        size = 0
        if most:
            if at + 4 > len(body):
                raise OutOfSpec("levels end early")
            size = int.from_bytes(body[at : at + 4], "little")
            at += 4
        if at + size > len(body):
            raise OutOfSpec("levels are longer than their page")
        parts.append(body[at : at + size])
        at += size
    return parts[0], parts[1], body[at:]


def split_v2(body: bytes, rep_size: int, def_size: int) -> tuple[bytes, bytes, bytes]:
    """The same by the sizes that a page header of version 2 has."""
    if rep_size < 0 or def_size < 0 or rep_size + def_size > len(body):
        raise OutOfSpec("levels are longer than their page")
    return body[:rep_size], body[rep_size : rep_size + def_size], body[rep_size + def_size :]


def hybrid(data: bytes, width: int, n: int) -> np.ndarray:
    """n numbers of a hybrid of runs and bit-packed groups; data that ends early stands for zeros."""
    out, at, have = [], 0, 0
    while have < n and at < len(data) and width:
        header, at = bytecodecs.from_uleb128(data, at)
        if header & 1:
            count, size = 8 * (header >> 1), (header >> 1) * width
            bits = np.unpackbits(np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8), bitorder="little").reshape(-1, width)
            out.append(bits @ (1 << np.arange(width, dtype=np.int64)))
        else:
            count, size = header >> 1, -(-width // 8)
            out.append(np.full(min(count, n - have), int.from_bytes(data[at : at + size], "little"), np.int64))
        at += size
        have += count
    found = np.concatenate(out)[:n] if out else np.zeros(0, np.int64)
    return np.concatenate((found, np.zeros(n - len(found), np.int64)))


def fixed(data: bytes, size: int) -> list[bytes]:
    """Values of a fixed number of bytes."""
    if size <= 0 or len(data) % size:
        raise OutOfSpec(f"{len(data)} bytes are no values of {size}")
    return [data[i : i + size] for i in range(0, len(data), size)]


def plain(data: bytes, leaf, n: int):
    """n values as a numpy array (numbers, booleans) or a list of bytes."""
    if leaf.physical in DTYPES:
        size = SIZES[leaf.physical]
        if n * size > len(data):
            raise OutOfSpec("values end early")
        return np.frombuffer(data, DTYPES[leaf.physical], n)
    if leaf.physical == "BOOLEAN":
        if 8 * len(data) < n:
            raise OutOfSpec("values end early")
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)
    out = bytecodecs.from_plain_strings(data) if leaf.physical == "BYTE_ARRAY" else fixed(data[: n * (size := leaf.size or SIZES.get(leaf.physical, 0))], size)
    if len(out) < n:
        raise OutOfSpec("values end early")
    return out[:n]


def decoded(data: bytes, encoding: str, leaf, n: int, dictionary):
    """n values that are present, by the page's encoding."""
    if encoding == "PLAIN":
        return plain(data, leaf, n)
    if encoding in ("PLAIN_DICTIONARY", "RLE_DICTIONARY"):
        if dictionary is None:
            raise OutOfSpec("a dictionary is missing")
        index = hybrid(data[1:], data[0] if data else 0, n)
        if n and index.max() >= len(dictionary):
            raise OutOfSpec("an index is beyond the dictionary")
        return dictionary[index] if isinstance(dictionary, np.ndarray) else [dictionary[i] for i in index]
    if encoding == "RLE" and leaf.physical == "BOOLEAN":
        return hybrid(data[4:], 1, n).astype(bool)
    if encoding == "DELTA_BINARY_PACKED":
        return np.array(bytecodecs.from_delta(data)[0], np.int64).astype(DTYPES[leaf.physical])
    if encoding == "DELTA_LENGTH_BYTE_ARRAY":
        return bytecodecs.from_delta_lengths(data)
    if encoding == "DELTA_BYTE_ARRAY":
        return bytecodecs.from_delta_strings(data)
    raise FeatureNotSupported(f"encoding {encoding} of {leaf.physical}")


def arrow(values, valid: np.ndarray | None, leaf, target: pa.DataType) -> pa.Array:
    """The values at their places, nulls elsewhere, in the type that is wanted."""
    n = len(values) if valid is None else len(valid)
    if leaf.physical == "INT96":
        days = np.frombuffer(b"".join(values), np.dtype([("nanos", "<i8"), ("day", "<i4")])) if values else np.zeros(0, np.dtype([("nanos", "<i8"), ("day", "<i4")]))
        values = (days["day"].astype(np.int64) - 2_440_588) * 86_400_000_000 + days["nanos"] // 1000
    if leaf.decimal:
        numbers = [int.from_bytes(x, "big", signed=True) if isinstance(x, bytes) else int(x) for x in values]
        dense = pa.array([Decimal(x).scaleb(-(leaf.scale or 0)) for x in numbers], target)
    elif isinstance(values, np.ndarray):
        dense = pa.array(values)
    else:
        dense = pa.array(values, pa.binary())
    if valid is not None:
        place = np.cumsum(valid) - 1
        dense = dense.take(pa.array(np.where(valid, place, 0), mask=~valid)) if len(dense) else pa.nulls(n, dense.type)
    if dense.type == target:
        return dense
    unit = {True: "ms", False: "us"}[leaf.converted == 9 or 1 in leaf.logical.get(8, {}).get(2, {})] if pa.types.is_timestamp(target) else None
    if unit:
        unit = "ns" if 3 in leaf.logical.get(8, {}).get(2, {}) else unit
        return dense.cast(pa.timestamp(unit, target.tz)).cast(target, safe=False)
    return dense.cast(target)
