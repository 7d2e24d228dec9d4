"""A wavelet matrix over token ids: one succinct bit-plane per bit, with rank and select.

The file of a shard (all numbers little-endian):

    magic b"TSWM1\\0\\0\\0", u64 tokens, u64 symbols, u64 planes, u64 documents,
    u32 symbol ids [symbols], ascending
    i64 document ids [documents], u8 null marks [documents], u64 first tokens [documents + 1]
    for each plane, from the highest bit: u64 zeros, u32 ranks [blocks + 1], u64 words [blocks * 8]

Ids are numbered within the shard, so a shard has as many planes as its own
vocabulary needs.  A block is 512 bits; ``ranks`` are the set bits before it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TSWM1\0\0\0"
_BLOCK = 512


class WaveletMatrix:
    """Token access, counting and occurrence lookup without decoding the shard."""

    def __init__(
        self, n: int, symbols: np.ndarray, zeros: list[int], words: list[np.ndarray], ranks: list[np.ndarray],
        docs: list[int | None], starts: np.ndarray
    ):
        self.n, self.symbols, self.zeros, self.words, self.ranks, self.docs, self.starts = n, symbols, zeros, words, ranks, docs, starts

    @classmethod
    def build(cls, ids: np.ndarray, docs: list[int | None], starts: np.ndarray) -> WaveletMatrix:
        """From all ids of a shard and its documents' first tokens (one more at the end)."""
        n = len(ids)
        symbols = np.flatnonzero(np.bincount(ids)).astype(np.uint32) if n else np.zeros(0, np.uint32)
        code = np.zeros(int(symbols[-1]) + 1 if n else 1, np.uint32)
        code[symbols] = np.arange(len(symbols), dtype=np.uint32)
        now = code[ids] if n else np.zeros(0, np.uint32)
        if len(symbols) <= 1 << 16:
            now = now.astype(np.uint16)
        zeros, words, ranks = [], [], []
        for level in range(max(0, len(symbols) - 1).bit_length() - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.zeros(-(-max(n, 1) // _BLOCK) * _BLOCK // 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(bit, bitorder="little")
            w = packed.view("<u8")
            words.append(w)
            ranks.append(np.append(0, np.cumsum(np.bitwise_count(w).reshape(-1, 8).sum(1, dtype=np.int64))).astype("<u4"))
            low = now[~bit]
            zeros.append(len(low))
            now = np.concatenate((low, now[bit]))
        return cls(n, symbols, zeros, words, ranks, docs, np.asarray(starts))

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<4Q", self.n, len(self.symbols), len(self.zeros), len(self.docs)), self.symbols.astype("<u4").tobytes()]
        out += [
            np.array([d or 0 for d in self.docs], "<i8").tobytes(),
            np.array([d is None for d in self.docs], np.uint8).tobytes(), self.starts.astype("<u8").tobytes()
        ]
        for z, r, w in zip(self.zeros, self.ranks, self.words, strict=True):
            out += [struct.pack("<Q", z), r.tobytes(), w.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, n_symbols, planes, n_docs = struct.unpack_from("<4Q", data, 8)
        at = 40

        def take(dtype: str, k: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, dtype, k, at)
            at += a.nbytes
            return a

        symbols, docs, null, starts = take("<u4", n_symbols), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1)
        blocks = -(-max(n, 1) // _BLOCK)
        zeros, ranks, words = [], [], []
        for _ in range(planes):
            zeros.append(int(take("<u8", 1)[0]))
            ranks.append(take("<u4", blocks + 1))
            words.append(take("<u8", blocks * 8))
        return cls(
            n, symbols, zeros, words, ranks,
            [None if z else d for d, z in zip(docs.tolist(), null.tolist(), strict=True)], starts.astype(np.int64)
        )

    def _rank1(self, p: int, i: np.ndarray) -> np.ndarray:
        """Set bits of plane ``p`` before each place."""
        i = np.asarray(i, np.int64)
        block, word = i // _BLOCK, i // 64
        out = self.ranks[p][block].astype(np.int64)
        for k in range(7):
            whole = block * 8 + k < word
            out[whole] += np.bitwise_count(self.words[p][(block * 8 + k)[whole]])
        rest = i % 64 > 0
        mask = (np.uint64(1) << (i[rest] % 64).astype(np.uint64)) - np.uint64(1)
        out[rest] += np.bitwise_count(self.words[p][word[rest]] & mask)
        return out

    def _bit(self, p: int, i: np.ndarray) -> np.ndarray:
        return (self.words[p][i // 64] >> (i % 64).astype(np.uint64) & np.uint64(1)).astype(bool)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        i = np.asarray(places, np.int64).copy()
        value = np.zeros(len(i), np.int64)
        for p, z in enumerate(self.zeros):
            bit, ones = self._bit(p, i), self._rank1(p, i)
            value = value * 2 + bit
            i = np.where(bit, z + ones, i - ones)
        return self.symbols[value] if len(i) else np.zeros(0, np.uint32)

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.symbols, token))
        return k if k < len(self.symbols) and self.symbols[k] == token else None

    def rank(self, token: int, place: int) -> int:
        """How often ``token`` occurs before ``place``."""
        code = self._code(token)
        if code is None:
            return 0
        low, high = 0, place
        for p, z in enumerate(self.zeros):
            a, b = self._rank1(p, np.array([low, high])).tolist()
            low, high = (z + a, z + b) if code >> (len(self.zeros) - 1 - p) & 1 else (low - a, high - b)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``token``."""
        code = self._code(token)
        if code is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = 0
        for p, z in enumerate(self.zeros):
            ones = int(self._rank1(p, np.array([at]))[0])
            at = z + ones if code >> (len(self.zeros) - 1 - p) & 1 else at - ones
        at += k
        for p in range(len(self.zeros) - 1, -1, -1):
            z = self.zeros[p]
            at = self._select(p, at - z, True) if at >= z else self._select(p, at, False)
        return at

    def _select(self, p: int, k: int, one: bool) -> int:
        """The place of bit ``k`` of a kind in plane ``p``: a binary search in the block ranks, then the words."""
        ranks = self.ranks[p].astype(np.int64)
        if not one:
            ranks = np.arange(len(ranks)) * _BLOCK - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        k -= int(ranks[block])
        bits = np.unpackbits(self.words[p][block * 8 : block * 8 + 8].view(np.uint8), bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == (1 if one else 0))[k])

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest, each one a scatter in order."""
        value = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for p in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.words[p].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(value)
            up[~bit] = value[: self.zeros[p]]
            up[bit] = value[self.zeros[p] :] | value.dtype.type(1 << (len(self.zeros) - 1 - p))
            value = up
        return self.symbols[value] if self.n else np.zeros(0, np.uint32)
