"""Word scanning over Arrow string columns, one NumPy pass for a whole batch.

All operators that look at words share these helpers.  They work on the bytes
of a batch, so a word is never turned into a Python string; memory is bounded
by :func:`slices`, which cuts a batch into pieces of a few megabytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words for shingles: everything but the space and the control blanks \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Words for decontamination: digits, letters (after lower-casing) and all bytes from 0x80.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z hash as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes of text (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield at, end
        at = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's first byte (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word, and how many words each row has."""
    word = ~separator[data]
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = off[1:-1]
    before[inner[inner < len(word)]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes: sum of byte value times a power of its place, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
        value = byte[data[place + np.repeat(starts, size)]]
        value *= power[place]
        return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def words(column: pa.Array, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z) in order, and how many each row has."""
    data, off = raw(column)
    starts, ends, count = spans(data, off, separator)
    return word_hashes(data, starts, ends), count


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles; a shorter row's words make one, no words none."""
    h, count = words(column, BLANK)
    coeff = mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    n = max(0, len(h) - width + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(n, np.uint64)
        for k in range(width):
            run += h[k : k + n] * coeff[k]
        run = mix(run)
        out, at = [], 0
        for c in count.tolist():
            if c >= width:
                s = np.sort(run[at : at + c - width + 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            elif c:
                out.append(mix(np.array([(h[at : at + c] * coeff[:c]).sum(dtype=np.uint64) ^ np.uint64(c)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
    return out
