"""Bloom filters of 128-bit keys, built per partition and merged segment by segment (problems 1 and 6).

A filter is saturating: beside the bits seen once it keeps those seen repeatedly. A key is two 64-bit halves, each the
place of one bit, so a key whose two bits are unset is certainly not there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits per key, at least, and the bits a filter that is sent to all tasks may have: 32 MB.
BITS_PER_KEY = 16
MAX_BITS = 1 << 28
SEGMENT_BITS = 1 << 20
_SCHEMA = "segment int, once binary, more binary"


def bits_for(keys: int) -> int:
    """The bits of a filter of so many keys, a power of two; it may exceed MAX_BITS."""
    return 1 << max(10, (max(1, keys * BITS_PER_KEY) - 1).bit_length())


def positions(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key, by the low bits of both halves."""
    return hi.view(np.uint64) & np.uint64(bits - 1), lo.view(np.uint64) & np.uint64(bits - 1)


def halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo"))


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    """Set bits; repeats allowed."""
    np.bitwise_or.at(bitmap, (places >> np.uint64(3)).astype(np.int64), np.left_shift(1, (places & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def test(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Saturating:
    """The bits that keys set once, and those they set more than once."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.more = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        p, q = positions(hi, lo, self.bits)
        order = np.lexsort((q, p))
        a, b = p[order], q[order]
        again = order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        for x in (p, q):
            _set(self.more, x[test(self.once, x)])
            _set(self.more, x[again])
        for x in (p, q):
            _set(self.once, x)

    def repeated(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """False only for keys that were added at most once."""
        p, q = positions(hi, lo, self.bits)
        return test(self.more, p) & test(self.more, q)


def _build(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The filter of one partition, as compressed segments; empty segments are left out."""
    own, any_rows = Saturating(bits), False
    for batch in batches:
        any_rows |= batch.num_rows > 0
        own.add(*halves(batch))
    if any_rows:
        step = min(SEGMENT_BITS, bits) // 8
        for k in range(0, len(own.once), step):
            o, m = own.once[k : k + step], own.more[k : k + step]
            if o.any():
                yield _segment(k // step, o, m)


def _segment(k: int, once: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    blobs = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, more)]
    return pa.record_batch([pa.array([k], pa.int32()), *blobs], names=["segment", "once", "more"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows that are sorted by segment: seen twice is seen in two partitions, or repeatedly in one."""
    at = once = more = None
    for batch in batches:
        for row in batch.to_pylist():
            o, m = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "more"))
            if row["segment"] != at:
                if at is not None:
                    yield _segment(at, once, more)
                at, once, more = row["segment"], o.copy(), m.copy()
            else:
                more |= m | (once & o)
                once |= o
    if at is not None:
        yield _segment(at, once, more)


def merged(keys: DataFrame, bits: int, repeated: bool):
    """A broadcast of the merged bits of all ``keys`` (hi, lo): of those set repeatedly, or of all.

    ``bits`` is at most MAX_BITS, so the driver gathers, and every task gets, 32 MB at most.
    """
    if bits > MAX_BITS:
        raise ValueError(f"a filter that is sent to all tasks has at most {MAX_BITS} bits")
    built = keys.select("hi", "lo").mapInArrow(partial(_build, bits=bits), _SCHEMA)
    whole = built.repartition(F.col("segment")).sortWithinPartitions("segment").mapInArrow(_merge, _SCHEMA)
    bitmap, step = np.zeros(bits // 8, np.uint8), min(SEGMENT_BITS, bits) // 8
    for k, blob in whole.select("segment", "more" if repeated else "once").collect():
        bitmap[k * step : (k + 1) * step] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def probe(bitmap: bytes, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether a broadcast filter may hold each key."""
    b = np.frombuffer(bitmap, np.uint8)
    p, q = positions(hi, lo, len(b) * 8)
    return test(b, p) & test(b, q)
