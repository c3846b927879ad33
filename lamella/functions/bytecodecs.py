"""Byte-level encodings of pages, for small conformance data; queries use relational forms instead."""

from __future__ import annotations

from ..errors import OutOfSpec


def uleb128(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def from_uleb128(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number, and where the bytes after it begin."""
    n = 0
    for i in range(10):
        if at >= len(data):
            raise OutOfSpec("a number ends early")
        n |= (data[at] & 0x7F) << (7 * i)
        at += 1
        if not data[at - 1] & 0x80:
            return n, at
    raise OutOfSpec("a number has more than ten bytes")


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def from_zigzag(z: int) -> int:
    return z >> 1 if z % 2 == 0 else -(z >> 1) - 1


def pack(values: list[int], width: int) -> bytes:
    """Numbers of `width` bits one after another, least bit first, filled up to whole bytes."""
    bits = 0
    for i, v in enumerate(values):
        bits |= (v & ((1 << width) - 1)) << (i * width)
    return bits.to_bytes(-(-len(values) * width // 8), "little")


def unpack(data: bytes, width: int, n: int) -> list[int]:
    if 8 * len(data) < n * width:
        raise OutOfSpec("packed numbers end early")
    bits, mask = int.from_bytes(data, "little"), (1 << width) - 1
    return [bits >> (i * width) & mask for i in range(n)]


def hybrid(values: list[int], width: int) -> bytes:
    """Runs of eight or more equal values as runs, the rest bit-packed in groups of eight."""
    out, at, waiting = bytearray(), 0, []

    def flush() -> None:
        if waiting:
            groups = -(-len(waiting) // 8)
            out.extend(uleb128(groups << 1 | 1) + pack(waiting + [0] * (8 * groups - len(waiting)), width))
            waiting.clear()

    while at < len(values):
        end = at
        while end < len(values) and values[end] == values[at]:
            end += 1
        while len(waiting) % 8 and at < end:
            waiting.append(values[at])
            at += 1
        if end - at >= 8:
            flush()
            out.extend(uleb128((end - at) << 1) + values[at].to_bytes(-(-width // 8), "little"))
            at = end
        elif at < end:
            waiting.extend(values[at:end])
            at = end
    flush()
    return bytes(out)


def from_hybrid(data: bytes, width: int, n: int) -> list[int]:
    """n values; data that ends early stands for zeros."""
    out: list[int] = []
    at = 0
    while len(out) < n and at < len(data) and width:
        header, at = from_uleb128(data, at)
        if header & 1:
            size = (header >> 1) * width
            part = data[at : at + size].ljust(size, b"\0")
            out += unpack(part, width, 8 * (header >> 1))
            at += size
        else:
            size = -(-width // 8)
            out += [int.from_bytes(data[at : at + size], "little")] * (header >> 1)
            at += size
    return (out + [0] * n)[:n]


def delta(values: list[int], block: int = 128, minis: int = 4) -> bytes:
    """DELTA_BINARY_PACKED: a header, then blocks of a least delta and bit-packed miniblocks."""
    out = bytearray(uleb128(block) + uleb128(minis) + uleb128(len(values)) + uleb128(zigzag(values[0] if values else 0)))
    steps = [b - a for a, b in zip(values, values[1:])]
    per = block // minis
    for at in range(0, len(steps), block):
        part = steps[at : at + block]
        least = min(part)
        rest = [x - least for x in part]
        groups = [rest[i : i + per] for i in range(0, block, per)]
        widths = [max(g).bit_length() if g else 0 for g in groups]
        out += uleb128(zigzag(least)) + bytes(widths)
        for g, w in zip(groups, widths):
            if g:
                out += pack(g + [0] * (per - len(g)), w)
    return bytes(out)


def from_delta(data: bytes) -> tuple[list[int], int]:
    """The values, and where the bytes after them begin."""
    block, at = from_uleb128(data)
    minis, at = from_uleb128(data, at)
    n, at = from_uleb128(data, at)
    first, at = from_uleb128(data, at)
    if block % 128 or not minis or block % minis:
        raise OutOfSpec("blocks have a multiple of 128 values")
    out, per = ([from_zigzag(first)] if n else []), block // minis
    while len(out) < n:
        least, at = from_uleb128(data, at)
        least = from_zigzag(least)
        widths = data[at : at + minis]
        at += minis
        for w in widths:
            if len(out) >= n:
                break
            size = per * w // 8
            for x in unpack(data[at : at + size], w, per)[: n - len(out)]:
                out.append(out[-1] + least + x)
            at += size
    return out, at


def delta_lengths(values: list[bytes]) -> bytes:
    return delta([len(v) for v in values]) + b"".join(values)


def from_delta_lengths(data: bytes) -> list[bytes]:
    sizes, at = from_delta(data)
    out = []
    for n in sizes:
        if at + n > len(data):
            raise OutOfSpec("strings end early")
        out.append(data[at : at + n])
        at += n
    return out


def delta_strings(values: list[bytes]) -> bytes:
    """DELTA_BYTE_ARRAY: shared prefixes, then the rests by length."""
    prefixes, rests, before = [], [], b""
    for v in values:
        n = 0
        while n < min(len(v), len(before)) and v[n] == before[n]:
            n += 1
        prefixes.append(n)
        rests.append(v[n:])
        before = v
    return delta(prefixes) + delta_lengths(rests)


def from_delta_strings(data: bytes) -> list[bytes]:
    prefixes, at = from_delta(data)
    out: list[bytes] = []
    for n, rest in zip(prefixes, from_delta_lengths(data[at:])):
        out.append((out[-1][:n] if out else b"") + rest)
    return out


def plain_strings(values: list[bytes]) -> bytes:
    return b"".join(len(v).to_bytes(4, "little") + v for v in values)


def from_plain_strings(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + n > len(data):
            raise OutOfSpec("a string is longer than its page")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
