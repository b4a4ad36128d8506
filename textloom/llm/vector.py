"""Vectorised words and hashes of many texts at once. Hashes are fixed functions of the bytes, the same in every process."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Multiplier of the polynomial hash, odd, so that it has an inverse modulo 2**64.
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)
#: Which bytes are white space: space, tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of a text that are hashed together.
TOGETHER = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept and grows by doubling."""
    t = _powers.get(base)
    if t is None:
        t = np.ones(1, U)
    while len(t) < n:
        t = np.concatenate([t, t * U(pow(base, len(t), 1 << 64))])
    _powers[base] = t
    return t[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a space after each, and where each begins (with the total at the end)."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buffer, starts


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts: where they start and end, their texts and hashes."""

    def __init__(self, texts: list[bytes]):
        self.bytes, self.text_start = joined(texts)
        space = SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)  # number of the first word of each text, and the total
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, values: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (of ``values`` in the place of the bytes, as after lower-casing)."""
        v = self.bytes if values is None else values
        out = np.empty(len(self.start), U)
        i = 0
        while i < len(out):  # some words at a time: a hash does not depend on where its word stands
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + TOGETHER, "right")))
            a, z = int(self.start[i]), int(self.end[j - 1])
            total = np.zeros(z - a + 1, U)
            np.cumsum((v[a:z].astype(U) + U(1)) * powers(P, z - a), out=total[1:])
            out[i:j] = mix((total[self.end[i:j] - a] - total[self.start[i:j] - a]) * powers(P_INVERSE, z - a)[self.start[i:j] - a])
            i = j
        return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the slices of ``values`` that ``first`` (starts, then the total) bounds."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
