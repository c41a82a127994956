"""Hashed character n-grams of whole texts, computed over the bytes of a record batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidewatch.llm.common import utf8_bytes

#: Fixed value: bytes of letters keep their lower-case value, all others become a blank.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def letter_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letter bytes, each run of other bytes as one blank, and the row of each byte.

    Every row begins and ends with a blank, so the edges of words look alike everywhere.
    """
    flat, offsets = utf8_bytes(texts)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
    out = np.full(len(flat) + 2 * len(sizes), 32, np.uint8)
    out[np.arange(len(flat)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = LETTERS[flat]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32) | (row[1:] != row[:-1])
    return out[keep], row[keep]


def hashed(letters: np.ndarray, row: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` bytes inside a row, below ``2 ** bits``, and its row."""
    if len(letters) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    size = len(letters) - n + 1
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= letters[k:k + size]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - bits)
    inside = row[n - 1:] == row[:size]
    return h[inside], row[:size][inside]
