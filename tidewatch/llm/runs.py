"""Runs of bytes inside whole texts (words), found, hashed and counted for many texts at once."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidewatch.llm.common import utf8_bytes

#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 2_000_000
#: Distinct strings that a task holds before it sends them on.
HELD = 1_000_000
#: Bytes from which a run is hashed on its own.
LONG = 64
MULT = np.uint64(0x9E3779B97F4A7C15)
#: The table of the CRC-32 of zlib, one byte a step.
CRC = np.zeros(256, np.uint32)
for _b in range(256):
    _c = _b
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    CRC[_b] = _c


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a string array of about ``SLICE`` bytes: first row, bytes (zero copy) and offsets; null is empty."""
    flat, offsets = utf8_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, flat[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of the maximal runs of marked bytes; no run crosses the edge of a row."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | np.r_[True, ~inside[:-1]])) if len(inside) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True])) + 1 if len(inside) else np.zeros(0, np.int64)
    return start, stop - start, np.searchsorted(offsets, start, side="right") - 1


class Lanes:
    """Runs side by side, the short first, so that a step over all their k-th bytes is one array operation.

    ``steps`` yields, for k = 0, 1, ..., where the lanes with such a byte begin, and those bytes. Runs longer than
    ``LONG`` are in ``long`` instead.
    """

    def __init__(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.flat, short = flat, np.flatnonzero(length <= LONG)
        self.long = np.flatnonzero(length > LONG)
        self.order = short[np.argsort(length[short].astype(np.uint8), kind="stable")]
        self.start, self.length = start[self.order], length[self.order]

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        most = int(self.length[-1]) if len(self.length) else 0
        begin = np.searchsorted(self.length, np.arange(most), side="right")
        for k in range(most):
            yield begin[k], self.flat[self.start[begin[k]:] + k]


def hashes(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of every run."""
    lanes = Lanes(flat, start, length)
    h = np.full(len(lanes.order), np.uint64(0xCBF29CE484222325))
    for begin, byte in lanes.steps():
        h[begin:] = (h[begin:] ^ byte) * MULT
    out = np.empty(len(start), np.uint64)
    out[lanes.order] = h
    for i in lanes.long:
        out[i] = int.from_bytes(hashlib.blake2b(flat[start[i]:start[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32)) ^ length.astype(np.uint64)


def crcs(flat: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of every run, continued from the CRC-32 ``before`` it."""
    lanes = Lanes(flat, start, length)
    c = ~before[lanes.order].astype(np.uint32)
    for begin, byte in lanes.steps():
        c[begin:] = CRC[(c[begin:] ^ byte) & np.uint32(255)] ^ c[begin:] >> np.uint32(8)
    out = np.empty(len(start), np.uint32)
    out[lanes.order] = ~c
    for i in lanes.long:
        out[i] = zlib.crc32(flat[start[i]:start[i] + length[i]].tobytes(), int(before[i]))
    return out


def strings(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The runs as a binary column."""
    stop = np.cumsum(length)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)
    offsets = np.zeros(len(start) + 1, np.int32)
    offsets[1:] = stop
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat[at]))])


class Counts:
    """Sums by string, held until they are many."""

    def __init__(self, *names: str):
        self.names, self.held, self.rows = names, [], 0

    def add(self, keys: pa.Array, *sums: np.ndarray) -> None:
        self.held.append(pa.table([keys, *(pa.array(s, pa.int64()) for s in sums)], names=["key", *self.names]))
        self.rows += len(keys)

    def out(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        """The sums, when they are many or ``all_`` are asked for."""
        if self.rows and (all_ or self.rows > HELD):
            whole = pa.concat_tables(self.held).combine_chunks()
            whole = whole.group_by("key").aggregate([(n, "sum") for n in self.names]).select(["key", *(n + "_sum" for n in self.names)]).rename_columns(["key", *self.names])
            if all_ or whole.num_rows > HELD // 2:
                self.held, self.rows = [], 0
                yield from whole.combine_chunks().to_batches(max_chunksize=65_536)
            else:
                self.held, self.rows = [whole], whole.num_rows
