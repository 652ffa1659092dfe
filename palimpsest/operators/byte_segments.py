"""Safe segments of bytes that may not be UTF-8: invalid bytes are boundaries, as escapes, control and format characters are.

A batch's values are looked at together, in numpy over Arrow's buffers: a byte starts a character if
the bytes after it fit it by the rules of UTF-8 (no overlong forms, surrogates or values over
U+10FFFF); a byte that neither starts nor continues one is invalid. As continuation bytes never start
a character, that is what a decoder finds that goes on by one byte after each invalid one. Only
escape sequences are followed one by one.

Null and empty values have no segments.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from .python_columns import small_batches

#: Bytes of values that are looked at together.
TOGETHER = 1 << 18
ESCAPE, BELL = 0x1B, 0x07
#: Beginnings of escape sequences that a bell or ESC \\ ends.
STRINGS = np.frombuffer(b"]PX^_", np.uint8)
SEGMENTS = "array<struct<off:int,seg:string>>"


def format_characters() -> np.ndarray:
    return np.array([c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"], np.int64)


FORMAT = format_characters()


def characters(raw: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of the character that each byte starts (0 if it starts none) and its code point; left: bytes to the end of the byte's value."""
    n = len(raw)
    after = [np.append(raw[k:], np.zeros(min(k, n), np.uint8)) for k in (1, 2, 3)]
    more = [(x & 0xC0) == 0x80 for x in after]
    b, second = raw, after[0]
    fits = more[0] & (left >= 2)
    fits &= ~((b == 0xE0) & (second < 0xA0)) & ~((b == 0xED) & (second > 0x9F)) & ~((b == 0xF0) & (second < 0x90)) & ~((b == 0xF4) & (second > 0x8F))
    size = np.where(b < 0x80, 1, 0)
    size = np.where((b >= 0xC2) & (b <= 0xDF) & fits, 2, size)
    size = np.where((b >= 0xE0) & (b <= 0xEF) & fits & more[1] & (left >= 3), 3, size)
    size = np.where((b >= 0xF0) & (b <= 0xF4) & fits & more[1] & more[2] & (left >= 4), 4, size)
    w = [b.astype(np.int64), *((x & 0x3F).astype(np.int64) for x in after)]
    point = np.select([size == 2, size == 3, size == 4], [(w[0] & 0x1F) << 6 | w[1], (w[0] & 0x0F) << 12 | w[1] << 6 | w[2], (w[0] & 0x07) << 18 | w[1] << 12 | w[2] << 6 | w[3]], w[0])
    return size, point


def protected(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes of values (from starts to ends, one after another) no segment holds."""
    left = np.repeat(ends, ends - starts) - np.arange(len(raw))
    size, point = characters(raw, left)
    covered = size > 0
    for k in (1, 2, 3):
        covered[k:] |= (size > k)[:-k] if k < len(raw) else False
    out = ~covered
    bad = (size > 0) & (((point < 0x20) & ~np.isin(point, (9, 10, 13))) | ((point >= 0x7F) & (point <= 0x9F)) | np.isin(point, FORMAT))
    for k in range(4):
        at = np.flatnonzero(bad & (size > k)) + k
        out[at] = True
    escapes = np.flatnonzero(raw == ESCAPE)
    if len(escapes):
        final = np.flatnonzero((raw >= 0x40) & (raw <= 0x7E))
        strings_end = np.flatnonzero((raw == BELL) | ((raw == ESCAPE) & (np.append(raw[1:], 0) == ord("\\"))))
        stop, free = ends[np.searchsorted(ends, escapes, "right")].tolist(), 0
        for i, end in zip(escapes.tolist(), stop):
            if i < free:
                continue
            kind = raw[i + 1] if i + 1 < end else None
            if kind is None:
                to = i + 1
            elif kind == ord("["):
                k = np.searchsorted(final, i + 2)
                to = int(final[k]) + 1 if k < len(final) and final[k] < end else end
            elif kind in STRINGS:
                k = np.searchsorted(strings_end, i + 2)
                to = int(strings_end[k]) + (1 if raw[strings_end[k]] == BELL else 2) if k < len(strings_end) and strings_end[k] < end else end
                to = end if to > end else to
            else:
                to = i + 2
                while to < end and (raw[to] & 0xC0) == 0x80 and size[i + 1] > to - i - 1:  # what is left of a character that was cut
                    to += 1
            out[i:to] = True
            free = to
    return out


def segments_of(values: pa.Array) -> pa.Array:
    """list<struct<off, seg>> of each value of a binary array. Numbers for each byte take many times its size, so some values are looked at after others."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    made, done = [], 0
    while done < len(values) or not made:
        upto = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + TOGETHER, "right")), done + 1)
        made.append(segments_of_some(values.slice(done, upto - done)))
        done = upto
    return pa.concat_arrays(made)


def segments_of_some(values: pa.Array) -> pa.Array:
    values = values.cast(pa.large_binary()).fill_null(b"")  # an array of its own if there are nulls, which begins elsewhere in its buffers
    n = len(values)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset:values.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and n else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    kept = ~protected(raw, bounds[:-1], bounds[1:]) if len(raw) else np.zeros(0, bool)
    # a run begins where a kept byte follows none, or begins a value
    first = kept.copy()
    if len(raw):
        first[1:] &= ~kept[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[heads] = kept[heads]
    run = np.flatnonzero(first)
    owner = np.searchsorted(bounds, run, "right") - 1
    text = raw[kept]
    places = np.append(np.cumsum(kept)[run] - 1, len(text)) if len(run) else np.zeros(1, np.int64)
    seg = pa.Array.from_buffers(pa.large_string(), len(run), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.string())
    off = pa.array((run - bounds[owner]).astype(np.int32)) if len(run) else pa.array([], pa.int32())
    lists = np.append(0, np.cumsum(np.bincount(owner, minlength=n))) if n else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.StructArray.from_arrays([off, seg], ["off", "seg"]))


def safe_byte_segments(value: Column) -> Column:
    """array<struct<off, seg>> of a BINARY column."""
    small_batches(SparkSession.active())
    return F.arrow_udf(segments_of, SEGMENTS)(value)
