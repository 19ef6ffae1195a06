"""Texts as flat NumPy arrays: one byte buffer, word bounds and 64-bit word names for many documents at once.

A word is a maximal run of bytes outside ``[\x20\x09-\x0D]``; as those are ASCII, UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240613)
#: A random 64-bit value for each byte, and the odd base of the rolling names; two of each, for 128-bit checks.
BYTE = [_rng.integers(0, 2**64, 256, dtype=U) for _ in range(2)]
BASE = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)]
#: Bytes whose words are named at once.
RUN = 1 << 20
_powers: dict[int, list[np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of the public splitmix64 generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j for j < n, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.full(size, BASE[kind], U)
            up[0] = 1
            down = np.full(size, U(pow(int(BASE[kind]), -1, 2**64)), U)
            down[0] = 1
            have = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        if n <= 1 << 22:
            _powers[kind] = have
    return have[0], have[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes (a longer document alone): first, last, bytes, offsets."""
    buf, off = flat(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words of some documents: ``doc`` (index of the document), ``start``, ``end`` (bytes) and ``name`` (64 bits)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE, names: int = 1):
        inside = ~gap[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(buf))]
        first[cut] |= inside[cut]
        self.start = np.flatnonzero(first)
        stop = ~inside
        nxt = np.concatenate([self.start[1:], [len(buf)]]) if len(self.start) else self.start
        ends = np.flatnonzero(stop)
        at = np.searchsorted(ends, self.start)
        self.end = np.minimum(nxt, np.concatenate([ends, [len(buf)]])[at]) if len(self.start) else self.start
        self.count = np.diff(np.searchsorted(self.start, off))
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.names = [self._name(buf, k) for k in range(names)]
        self.name = self.names[0] if names else None

    def _name(self, buf: np.ndarray, kind: int) -> np.ndarray:
        """Sum of each word's bytes times powers of BASE from its start, scattered. Words go in runs of about RUN bytes, so a long text needs no wider arrays than a short one."""
        out = np.zeros(len(self.start), U)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(out):
                low = int(self.start[i])
                j = max(i + 1, int(np.searchsorted(self.end, low + RUN, "right")))
                high = int(self.end[j - 1])
                if high - low > RUN:  # one long word
                    total, step = 0, pow(int(BASE[kind]), RUN, 2**64)
                    for at in reversed(range(low, high, RUN)):
                        part = buf[at : min(at + RUN, high)]
                        total = (total * step + int((BYTE[kind][part] * _power(kind, RUN)[0][: len(part)]).sum(dtype=U))) % 2**64
                    out[i] = U(total)
                else:
                    up, down = _power(kind, high - low + 1)
                    total = np.zeros(high - low + 1, U)
                    np.cumsum(BYTE[kind][buf[low:high]] * up[: high - low], out=total[1:])
                    s, e = self.start[i:j] - low, self.end[i:j] - low
                    out[i:j] = (total[e] - total[s]) * down[s]
                i = j
            return mix(out + (self.end - self.start).astype(U))


def windows(words: Words, size: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``size`` words of one document begin, and the names of those sequences."""
    n = len(words.doc)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
    with np.errstate(over="ignore"):
        h = np.zeros(n - size + 1, U)
        for j in range(size):
            h = h * BASE[1 - kind] + words.names[kind][j : n - size + 1 + j]
        return at, mix(h[at])
