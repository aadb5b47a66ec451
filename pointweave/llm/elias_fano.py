"""Elias-Fano sequences as flat numpy arrays: non-decreasing numbers in about 2 + log2(universe / n) bits each.

The low bits of the numbers are packed one after another; the high bits are a unary bit vector with a directory of zeros
per 64-bit word. All queries are vectorised and touch only the words they need, so the arrays may be memory-mapped.
"""

from __future__ import annotations

import json

import numpy as np

#: position of the r-th set bit of a byte
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


class EliasFano:
    def __init__(self, n: int, low_bits: int, top: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.low_bits, self.top, self.low, self.high, self.zeros = n, low_bits, top, low, high, zeros
        self.mask = np.uint64((1 << low_bits) - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, -1, np.zeros(2, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64))
        low_bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        parts = []
        for at in range(0, n, 1 << 16):  # whole bytes: 2**16 numbers fill a multiple of eight bits
            block = values[at : at + (1 << 16)]
            parts.append(np.packbits(((block[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(-(-(n + int(high[-1]) + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])[:-1]
        return cls(n, low_bits, int(high[-1]), _words(np.concatenate(parts)), words, zeros)

    def _pick(self, word: np.ndarray, r: np.ndarray, ones: bool) -> np.ndarray:
        """Position in the bit vector of the r-th one or zero of each word."""
        bits = np.asarray(self.high[word])
        octets = np.ascontiguousarray(bits if ones else ~bits).view(np.uint8).reshape(-1, 8)
        seen = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        byte = (seen <= r[:, None]).sum(axis=1)
        row = np.arange(len(word))
        before = np.where(byte > 0, seen[row, byte - 1], 0)
        return word * 64 + byte * 8 + _SELECT[octets[row, byte], r - before]

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return self._pick(word, k - self.zeros[word], ones=False)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> off
        rest = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (first | rest) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        high = self._pick(word, i - ones[word], ones=True) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, v: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Position of each ``v``, searched only in [first, last) if given; -1 where it is not in the sequence."""
        out = np.full(len(v), -1, np.int64)
        high = (v >> np.uint64(self.low_bits)).astype(np.int64)
        here = np.flatnonzero((high <= self.top) & (high >= 0)) if self.n else np.empty(0, np.int64)
        if not len(here):
            return out
        h, want = high[here], v[here] & self.mask
        b = self._select0(h) - h
        a = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        if first is not None:
            a, b = np.maximum(a, first[here]), np.minimum(b, last[here])
        end = b.copy()
        while True:
            going = np.flatnonzero(a < b)
            if not len(going):
                break
            mid = (a[going] + b[going]) >> 1
            less = self._low(mid) < want[going]
            a[going[less]] = mid[less] + 1
            b[going[~less]] = mid[~less]
        inside = np.flatnonzero(a < end)
        hit = inside[self._low(a[inside]) == want[inside]]
        out[here[hit]] = a[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        head = np.array([self.n, self.low_bits, self.top], np.int64)
        return {f"{name}.head": head, f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def load(cls, name: str, arrays: dict[str, np.ndarray]) -> EliasFano:
        n, low_bits, top = arrays[f"{name}.head"].tolist()
        return cls(n, low_bits, top, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])


def _words(octets: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(octets) // 8) + 1, np.uint64)
    out.view(np.uint8)[: len(octets)] = octets
    return out


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: length of the directory, directory (JSON), arrays at multiples of 64 bytes."""
    directory, at, body = {}, 0, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        directory[name] = (a.dtype.str, at, len(a))
        body.append(data + b"\0" * (-len(data) % 64))
        at += len(body[-1])
    head = json.dumps(directory).encode()
    head = len(head).to_bytes(8, "little") + head
    return head + b"\0" * (-len(head) % 64) + b"".join(body)


def unpack(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(data[:8].tobytes(), "little")
    directory = json.loads(data[8 : 8 + size].tobytes())
    start = -(-(8 + size) // 64) * 64
    return {k: data[start + at : start + at + n * np.dtype(d).itemsize].view(d) for k, (d, at, n) in directory.items()}
