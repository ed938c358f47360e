"""Vectorised tokenising and hashing of whole texts inside Arrow batches.

Texts are handled as UTF-8 bytes: a word is a run of bytes that are no ASCII white space, A-Z count as
a-z, and a null text is an empty one. Words and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, which take about a hundred times as much while they are; a longer text is handled alone.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system when it ends, as its worker then waits for other tasks with all it took."""
    @functools.wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return done


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


WHITE = byte_table(b" \t\n\x0b\x0c\r")


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offs = utf8(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n, at + 4096)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words start among them."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~separator[data]
    first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    cuts = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    first[cuts] |= word[1:-1][cuts]
    last[cuts - 1] |= word[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (1 << 17))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[:1] = down[:1] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, A-Z taken as a-z, wherever the span stands."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower_table()[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text offsets among them, start bytes, end bytes) of all words."""
    starts, ends, at = spans(data, offs, separator)
    return hash_spans(data, starts, ends), at, starts, ends


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether the text has that many left."""
    n = len(hashes)
    out, valid = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            total = mix(total + hashes[i : n - k + 1 + i]) * _BASE
        out[: n - k + 1] = mix(total)
    size = np.diff(at)
    rank = np.arange(n) - np.repeat(at[:-1], size)
    valid[:] = rank + k <= np.repeat(size, size)
    return out, valid


def runs(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``shingles``, for long runs of words: one sum for all of them."""
    n = len(hashes)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes) * up[:n], out=total[1:])
    out = np.zeros(n, np.uint64)
    if n >= k:
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])
    size = np.diff(at)
    return out, np.arange(n) - np.repeat(at[:-1], size) + k <= np.repeat(size, size)


def owners(at: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def binary_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of a flat array as binary values, one for each text."""
    flat = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
