"""WebSocket frames as bytes: parsing and building. Reassembly of messages is in operators.audit."""

from __future__ import annotations

import struct
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F, types as T

from ..operators.python_columns import small_batches

FRAMES = T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("fin", T.BooleanType()), T.StructField("rsv", T.IntegerType()), T.StructField("opcode", T.IntegerType()), T.StructField("payload", T.BinaryType())]))


def masked(payload: bytes, mask: bytes) -> bytes:
    return bytes(b ^ mask[i % 4] for i, b in enumerate(payload))


def build_frame(payload: bytes, opcode: int = 1, fin: bool = True, rsv: int = 0, mask: bytes | None = None) -> bytes:
    n, marked = len(payload), 0x80 if mask else 0
    head = bytes([(0x80 if fin else 0) | rsv << 4 | opcode])
    if n < 126:
        head += bytes([marked | n])
    elif n < 1 << 16:
        head += bytes([marked | 126]) + struct.pack(">H", n)
    else:
        head += bytes([marked | 127]) + struct.pack(">Q", n)
    return head + (mask + masked(payload, mask) if mask else payload)


def parse_frames(raw: bytes | None) -> list[tuple[int, bool, int, int, bytes]]:
    """(seq, fin, rsv, opcode, payload) of each whole frame; a cut last frame is left out.

    A length over 63 bits is no frame: what is left passes on as it is, in a last row without an opcode.
    """
    found, at, raw = [], 0, bytes(raw or b"")
    while at + 2 <= len(raw):
        first, second = raw[at], raw[at + 1]
        n, at_next = second & 0x7F, at + 2
        if n >= 126:
            width = 2 if n == 126 else 8
            if at_next + width > len(raw):
                break
            n, at_next = int.from_bytes(raw[at_next:at_next + width], "big"), at_next + width
            if n >> 63:
                return [*found, (len(found), None, None, None, raw[at:])]
        mask = raw[at_next:at_next + 4] if second & 0x80 else b""
        begin = at_next + (4 if second & 0x80 else 0)
        if begin + n > len(raw):
            break
        payload = raw[begin:begin + n]
        found.append((len(found), bool(first & 0x80), first >> 4 & 7, first & 15, masked(payload, mask) if mask else payload))
        at = begin + n
    return found


def parsed_frames(raw: pa.Array) -> pa.Array:
    each = [parse_frames(r.as_buffer()) for r in raw]
    columns = list(zip(*(f for found in each for f in found))) or [()] * 5
    kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
    made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], FRAMES.elementType.names)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, each))], pa.int32()), made)


def frames_of(raw: Column | str) -> Column:
    """The frames of bytes, as parse_frames() gives them."""
    small_batches(SparkSession.active())
    return F.arrow_udf(parsed_frames, FRAMES)(raw)
