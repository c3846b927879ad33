"""The compact protocol in which footers, page headers and indexes are written.

A structure is read as a dict by field number; what the numbers mean is up to the reader.
"""

from __future__ import annotations

import struct as _struct

from ..errors import OutOfSpec

#: Wire types of the protocol (fixed values).
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
#: Structures within structures at most; real files have about eight.
DEPTH = 64


class Reader:
    """Reads values one after another from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _byte(self) -> int:
        if self.at >= len(self.data):
            raise OutOfSpec("the structure ends too early")
        self.at += 1
        return self.data[self.at - 1]

    def unsigned(self) -> int:
        out = shift = 0
        while True:
            b = self._byte()
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7
            if shift > 63:
                raise OutOfSpec("a number has more than 64 bits")

    def signed(self) -> int:
        n = self.unsigned()
        return (n >> 1) ^ -(n & 1)

    def binary(self) -> bytes:
        n = self.unsigned()
        if n > len(self.data) - self.at:
            raise OutOfSpec("a text is longer than the structure")
        self.at += n
        return self.data[self.at - n : self.at]

    def _value(self, kind: int, depth: int):
        if kind in (TRUE, FALSE):
            return self._byte() == TRUE
        if kind == BYTE:
            return _struct.unpack("b", bytes([self._byte()]))[0]
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == DOUBLE:
            self.at += 8
            return _struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == BINARY:
            return self.binary()
        if kind in (LIST, SET):
            head = self._byte()
            n = head >> 4 if head >> 4 != 15 else self.unsigned()
            if n > len(self.data) - self.at:
                raise OutOfSpec("a list is longer than the structure")
            return [self._value(head & 15, depth + 1) for _ in range(n)]
        if kind == MAP:
            n = self.unsigned()
            kinds = self._byte() if n else 0
            return {self._value(kinds >> 4, depth + 1): self._value(kinds & 15, depth + 1) for _ in range(n)}
        if kind == STRUCT:
            return self.struct(depth + 1)
        raise OutOfSpec(f"wire type {kind}")

    def struct(self, depth: int = 0) -> dict:
        if depth > DEPTH:
            raise OutOfSpec("structures are nested too deeply")
        out, field = {}, 0
        while True:
            head = self._byte()
            if head == 0:
                return out
            field = field + (head >> 4) if head >> 4 else self.signed()
            kind = head & 15
            out[field] = kind == TRUE if kind in (TRUE, FALSE) else self._value(kind, depth)
