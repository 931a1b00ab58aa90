"""Vectorised work on the UTF-8 bytes of many texts at once.

A column of texts is one byte buffer with offsets. Words, grams and their
64-bit hashes come from whole-array operations on it, in pieces of about
``PIECE`` bytes (a longer text is a piece of its own).

Hashes read eight bytes at a time and mix the state after each, so there is no sum in which
the differences of two texts could cancel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if binary.null_count:
        binary = pc.fill_null(binary, b"")
    _, offsets, data = binary.buffers()
    off = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    if data is None or not len(binary):
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n + 1)."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as an integer, with zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte spans; equal spans have equal hashes wherever they stand, and other seeds give independent ones."""
    words, at, left = eights(data), starts.astype(np.int64), (ends - starts).astype(np.int64)
    h = mix((left.astype(np.uint64) + np.uint64(2 * seed + 1)) * STEP)
    live = None
    while True:
        w = words[at] & FIRST[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ w)
        else:
            h[live] = mix((h[live] * STEP) ^ w)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes, 8 or more, from each position that has as many."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.array(eights(data))
    h = words[:n] * STEP
    for at in [*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h ^= h >> np.uint64(29)
        h += words[at : at + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def distinct_counts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many different hashes each of less than 2^18 groups of neighbours has, by their upper 46 bits."""
    groups = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    keys = np.sort((groups << np.uint64(46)) | (hashes[offsets[0] : offsets[-1]] >> np.uint64(18)))
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return np.bincount((keys[new] >> np.uint64(46)).astype(np.int64), minlength=len(offsets) - 1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
