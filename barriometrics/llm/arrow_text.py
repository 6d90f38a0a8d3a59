"""Whole texts inside tasks: Arrow columns as bytes, words and word hashes, in bounded pieces.

A task sees its rows as Arrow batches. ``pieces`` cuts a batch into runs of rows holding at most a few
megabytes of text (a longer text is a piece of its own), so memory follows one piece, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words end at ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words are letters and digits, and any byte of a character beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, cut so that each piece holds at most ``limit`` bytes of text or one row."""
    _, offsets = buffers(batch.column(text))
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, end - first)
        first = end
    release()


def release() -> None:
    """Gives memory that a batch has left free back to the system, so that a waiting worker holds little."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@cache
def _trim():
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def with_text(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """The batch with a column ``text``: its own, or that of its ``row`` structs, which isn't sent twice."""
    if "text" in batch.schema.names:
        return batch
    return pa.RecordBatch.from_arrays([*batch.columns, batch.column("row").field(name)], [*batch.schema.names, "text"])


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, powers of an odd multiplier and of its inverse, modulo 2**64."""
    values = np.random.default_rng(20_240_229).integers(1, 2**64, 256, np.uint64)
    multiplier = 0x9E3779B97F4A7C15
    steps = np.full(CHUNK_BYTES + 1, multiplier, np.uint64)
    back = np.full(CHUNK_BYTES + 1, pow(multiplier, -1, 2**64), np.uint64)
    steps[0] = back[0] = 1
    return values, np.cumprod(steps), np.cumprod(back)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bytes_hash(word: bytes) -> int:
    """The hash that ``words`` gives a word, here for one word of any length."""
    values = _powers()[0]
    total, power = 0, 1
    for byte in word:
        total = (total + int(values[byte]) * power) % 2**64
        power = power * 0x9E3779B97F4A7C15 % 2**64
    return int(_mixed(np.array([total], np.uint64))[0])


@dataclass
class Words:
    """All words of a piece in text order: row number, byte range in ``data``, 64-bit hash."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(column: pa.Array, kept: np.ndarray, lower: bool = True) -> Words:
    """Lower-case A-Z (unless not ``lower``), then take the runs of bytes marked in ``kept``; words never span rows."""
    data, offsets = buffers(column)
    data = LOWER[data] if lower else data
    values, powers, back = _powers()
    inside = kept[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + CHUNK_BYTES, "right")))
        a, b = start[first], end[last - 1]
        if b - a > CHUNK_BYTES:  # one word longer than a chunk
            hashes[first] = _long_hash(data[a:b], values, powers)
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[data[a:b]] * powers[: b - a], out=sums[1:])
            s = start[first:last] - a
            hashes[first:last] = (sums[end[first:last] - a] - sums[s]) * back[s]
        first = last
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, row, start, end, _mixed(hashes), len(offsets) - 1)


def _long_hash(data: np.ndarray, values: np.ndarray, powers: np.ndarray) -> int:
    total, power, step = 0, 1, int(powers[CHUNK_BYTES])
    for a in range(0, len(data), CHUNK_BYTES):
        part = data[a : a + CHUNK_BYTES]
        total = (total + int((values[part] * powers[: len(part)]).sum(dtype=np.uint64)) * power) % 2**64
        power = power * step % 2**64
    return total
