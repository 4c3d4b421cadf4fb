"""Variable-byte codes: seven bits a byte, low group first, the high bit on the last byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def encode(numbers) -> bytes:
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("only numbers from 0 have a code")
        while n > 127:
            out.append(n & 127)
            n >>= 7
        out.append(n | 128)
    return bytes(out)


def decode(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte & 128:
            out.append(n)
            n, shift = 0, 0
    return out


def _parts(counts: np.ndarray) -> np.ndarray:
    """Where parts of these sizes begin, and at last where they end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _like(rows: pa.Array) -> pa.Buffer | None:
    """The rows' validity as a bitmap of its own."""
    return None if not rows.null_count else pa.array(np.packbits(~rows.is_null().to_numpy(zero_copy_only=False), bitorder="little")).buffers()[1]


def encode_rows(rows: pa.Array) -> pa.Array:
    """encode() of every list of a batch, by one step for all first bytes, one for all second ones and so on."""
    sizes, values = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), rows.flatten()
    if values.null_count or (values := values.to_numpy(zero_copy_only=False).astype(np.int64)).min(initial=0) < 0:
        raise ValueError("only numbers from 0 have a code")
    took = np.ones(len(values), np.int64)
    for k in range(1, 9):
        took += values >= 1 << (7 * k)
    starts = _parts(took)
    out = np.zeros(starts[-1], np.uint8)
    for k in range(took.max(initial=0)):
        at = np.nonzero(took > k)[0]
        out[starts[at] + k] = (values[at] >> (7 * k) & 127) | np.where(took[at] == k + 1, 128, 0)
    offsets = starts[_parts(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [_like(rows), pa.py_buffer(offsets), pa.py_buffer(out)], rows.null_count)


def decode_rows(rows: pa.Array) -> pa.Array:
    """decode() of every code of a batch, all at once; bytes at a code's end that end no number are left out."""
    codes = rows.fill_null(b"")
    if not len(codes):
        return pa.array([], pa.list_(pa.int64()))
    _, places, data = codes.buffers()
    offsets = np.frombuffer(places, np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64)
    code = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    ends = np.nonzero(code & 128)[0]
    firsts = np.searchsorted(ends, offsets)
    # A number begins after the one before it, but not before its row.
    starts = np.maximum(np.concatenate([[0], ends + 1])[: len(ends)], offsets[np.searchsorted(offsets, ends, "right") - 1])
    took = ends + 1 - starts
    if took.max(initial=0) > 9:
        raise ValueError("a code is longer than any number's")
    values = np.zeros(len(ends), np.int64)
    for k in range(took.max(initial=0)):
        at = np.nonzero(took > k)[0]
        values[at] |= (code[starts[at] + k].astype(np.int64) & 127) << (7 * k)
    return pa.Array.from_buffers(pa.list_(pa.int64()), len(rows), [_like(rows), pa.py_buffer(firsts.astype(np.int32))], rows.null_count, children=[pa.array(values)])


@arrow_udf(T.BinaryType())
def encoded(numbers: pa.Array) -> pa.Array:
    return encode_rows(numbers)


@arrow_udf(T.ArrayType(T.LongType()))
def decoded(data: pa.Array) -> pa.Array:
    return decode_rows(data)


def size_of(number: Column) -> Column:
    """How many bytes the code of a number takes, without coding it."""
    return F.when(number < 1 << 7, 1).when(number < 1 << 14, 2).when(number < 1 << 21, 3).when(number < 1 << 28, 4).otherwise(5)
