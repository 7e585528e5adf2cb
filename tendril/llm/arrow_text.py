"""Text columns of Arrow batches as flat byte arrays, for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is a block of its own.
BLOCK = 1 << 21

#: ASCII word characters are digits and a-z after lower-casing; all bytes from 0x80 on count as word bytes.
LOWER_WORDS = np.full(256, 0x20, np.uint8)
LOWER_WORDS[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER_WORDS[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER_WORDS[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER_WORDS[0x80:] = np.arange(0x80, 0x100)
LOWER_WORDS_TABLE = LOWER_WORDS.tobytes()

#: Words parted by ASCII white space, all other bytes as they are, and with A-Z lower-cased.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
LOWER_SPACED = SPACED.copy()
LOWER_SPACED[0x41:0x5B] += 0x20

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    data, off = flat(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def range_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums P of (values[i] + 1) * base**i, so that a slice's polynomial hash is (P[e] - P[s]) * base**-s."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(inverse(base), len(prefix))[starts])


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n neighbouring values."""
    prefix = range_sums(hashes)
    s = np.arange(max(0, len(hashes) - n + 1))
    return slice_hash(prefix, s, s + n)


def word_bounds(norm: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and text numbers of the words of normalised bytes, in which 0x20 parts words."""
    inside = np.zeros(len(norm) + 2, bool)
    inside[1:-1] = norm != 0x20
    change = inside[1:] != inside[:-1]
    edge = np.zeros(len(norm) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (change | edge))
    ends = np.flatnonzero(inside[:-1] & (change | edge))
    texts = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, texts
