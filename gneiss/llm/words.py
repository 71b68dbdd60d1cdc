"""Words of texts as 64-bit hashes, computed over whole Arrow batches.

A word is a run of bytes other than the six ASCII white-space bytes; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts are handled together up to so many bytes; a longer text is handled alone, in slices that end at white space.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch to a Python worker holds, so that long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def hash_words(raw: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in an array of UTF-8 bytes."""
    if len(raw) > 2 * CHUNK_BYTES:
        found, lo = [], 0
        while lo < len(raw):
            hi = lo + CHUNK_BYTES
            while hi < len(raw) and not len(gaps := np.flatnonzero(_SPACE[raw[hi - CHUNK_BYTES : hi]])):
                hi += CHUNK_BYTES
            hi = len(raw) if hi >= len(raw) else hi - CHUNK_BYTES + int(gaps[-1]) + 1
            h, starts, ends = _hash_slice(raw[lo:hi], lower)
            found.append((h, starts + lo, ends + lo))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    return _hash_slice(raw, lower)


def _hash_slice(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if lower:
        raw = _LOWER[raw]
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    sizes = ends - starts
    letters = raw[inside[1:-1]].astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    letters += np.uint64(1)
    letters *= _pow(int(sizes.max()))[place]
    return mix(np.add.reduceat(letters, at) + sizes.astype(np.uint64)), starts, ends


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (from, to) of a string column with their word hashes and the word offsets of each row.

    The words of row i of the range are hashes[offsets[i - from]:offsets[i - from + 1]].
    """
    for lo, hi, hashes, offsets, *_ in chunks_with_bytes(column):
        yield lo, hi, hashes, offsets


def chunks_with_bytes(column: pa.Array, lower: bool = True):
    """As chunks(), followed by the lower-cased bytes with one line feed after each row, and the words' starts and ends in them."""
    raw, at = column_bytes(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, side="right")) - 1)
        sizes = np.diff(at[lo : hi + 1])
        ends = np.cumsum(sizes + 1)
        joined = np.full(int(ends[-1]), 10, dtype=np.uint8)
        body = np.ones(len(joined), dtype=bool)
        body[ends - 1] = False
        joined[body] = raw[at[lo] : at[hi]]
        if lower:
            joined = _LOWER[joined]
        hashes, starts, stops = hash_words(joined, lower=False)
        offsets = np.concatenate([[0], np.searchsorted(starts, ends)])
        yield lo, hi, hashes, offsets, joined, starts, stops
        lo = hi


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of the given arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers, as Spark holds them."""
    return x.astype(np.uint64, copy=False).view(np.int64)
