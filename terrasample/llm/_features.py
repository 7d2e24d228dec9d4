"""Sparse text features for the classifiers, as hashed word and shape counts.

The features of a text look at all of it: which words it has (hashed to a fixed
number of buckets) and shares of byte classes, word lengths, repeated words and
repeated lines.  Ids, sources, languages and labels are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from terrasample.llm import _text

#: Dense features, in the order of the columns that :func:`dense` returns.
DENSE = [
    "bias", "log_words", "upper", "digit", "symbol", "mark", "pipe", "space", "newline", "high", "long_word",
    "short_word", "word_repeat", "line_repeat", "symbol_end", "caps_word"
]

_CLASS = np.zeros((256, 8), bool)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~<>{}[]\\/_=+`", ".,;:!?'\"()-", "|", " \t", "\n")):
    _CLASS[[ord(c) for c in _chars], _i] = True
_CLASS[128:, 7] = True
_SYMBOL = _CLASS[:, 2].copy()
_CODE = (_CLASS * np.arange(1, 9)).sum(1).astype(np.uint8)  # classes don't overlap
_SYMBOL[ord("!")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _per_row(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``value`` over each row's stretch."""
    out = np.zeros(len(off) - 1)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.add.reduceat(value, off[some], dtype=np.float64)
    return out


def _repeated(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Share of each row's hashes that occurred before in the same row (told apart by 40 bits)."""
    with np.errstate(over="ignore"):
        key = np.sort(
            _text.mix(
                h + np.repeat(np.arange(len(count), dtype=np.uint64), count) * np.uint64(0x9E3779B97F4A7C15)
            ) >> np.uint64(24) | np.repeat(np.arange(len(count), dtype=np.uint64), count) << np.uint64(40)
        )
    again = np.zeros(len(h))
    again[1:] = key[1:] == key[:-1]
    off = np.append(0, np.cumsum(count))
    return _per_row(again, off) / np.maximum(count, 1)


def dense(column: pa.Array) -> np.ndarray:
    """The features named in DENSE, rows x features."""
    data, off = _text.raw(column)
    starts, ends, count = _text.spans(data, off, _text.NOT_ALNUM)
    h = _text.word_hashes(data, starts, ends)
    size = np.maximum(np.diff(off), 1)[:, None]
    cell = np.repeat(np.arange(len(count), dtype=np.int32) * 9, np.diff(off)) + _CODE[data]
    shares = np.bincount(cell, minlength=9 * len(count)).reshape(-1, 9)[:, 1:] / size
    woff = np.append(0, np.cumsum(count))
    n = np.maximum(count, 1)
    length = ends - starts
    blank_s, blank_e, blank_n = _text.spans(data, off, _text.BLANK)
    boff = np.append(0, np.cumsum(blank_n))
    ends_odd = _per_row(_SYMBOL[data[blank_e - 1]].astype(float), boff) / np.maximum(blank_n, 1) if len(blank_e) else np.zeros(len(count))
    upper = np.append(0, np.cumsum((data >= 0x41) & (data <= 0x5A)))
    caps = _per_row(((upper[ends] - upper[starts]) * 2 > length).astype(float), woff) / n if len(starts) else np.zeros(len(count))
    line_s, line_e, line_n = _text.spans(data, off, _NEWLINE)
    lines = _text.word_hashes(data, line_s, line_e)
    return np.stack([
        np.ones(len(count)), np.log1p(count) / 5, shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3], shares[:, 4] * 10, shares[:, 5], shares[:, 6], shares[:, 7],
        _per_row((length > 12).astype(float), woff) / n, _per_row((length < 4).astype(float), woff) / n, _repeated(h, count), _repeated(lines, line_n), ends_odd, caps,
    ], 1).astype(np.float32)


#: Lengths in bytes of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6, 7)


def word_features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket (of 2 ** bits) of every word and of every word's beginning of PREFIXES bytes, repeats included."""
    data, off = _text.raw(column)
    starts, ends, count = _text.spans(data, off, _text.NOT_ALNUM)
    row, size = np.repeat(np.arange(len(count), dtype=np.int64), count), ends - starts
    rows, keys = [row], [_text.word_hashes(data, starts, ends)]
    part = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        power = np.uint64(1)
        for j in range(max(PREFIXES)):
            power = power * _text._STEP + np.uint64(j)
            left = size > j
            part[left] += _text._BYTE[data[starts[left] + j]] * (power | np.uint64(1))
            if j + 1 in PREFIXES:
                rows.append(row[left])
                keys.append(_text.mix(part[left] + np.uint64(j + 1)))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)
