"""Words of many texts at once, and hashes of windows of them."""

from __future__ import annotations

import hashlib

import numpy as np

from .blocks import U64, mix

_ONE, _TWO = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def doubled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes (rows of two) of windows from those of their two halves."""
    return np.stack([mix(a[0] * _ONE + mix(b[0] ^ _TWO)), mix(a[1] * _TWO + mix(b[1] ^ _ONE))])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1)
#: Words of more bytes are hashed one by one.
LONG = 64


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits, as two rows, for the words of ``data``, which ends with eight bytes more.

    Eight bytes at a time enter a chain of bijective mixings; words of equal length up to eight bytes never share a hash.
    """
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.stack([mix(size.astype(U64) * _ONE), mix(size.astype(U64) * _TWO)])
    left = np.arange(len(start))
    for at in range(0, LONG, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        rest = size[left] - at
        chunk = eight[start[left] + at]
        chunk = np.where(rest < 8, chunk & _MASK[np.minimum(rest, 7)], chunk)
        h[:, left] = doubled(h[:, left], np.stack([chunk, chunk]))
    for i in np.flatnonzero(size > LONG).tolist():
        h[:, i] = np.frombuffer(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=16).digest(), "<u8")
    return h


class Windows:
    """The words of texts by text, and hashes of all windows of a length that grows."""

    def __init__(self, texts: list[bytes], usable: np.ndarray | None = None):
        data = np.frombuffer(b"\n".join([*texts, b" " * 8]), np.uint8)
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]])
        start, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(ends, start, "right")
        self.length, self.hash = 1, word_hashes(data, start, end - start)
        self.usable = np.ones(len(start), bool) if usable is None else usable[self.doc]  # windows of other texts are none

    def grow(self, length: int) -> None:
        while self.length < length:
            shift = min(self.length, length - self.length)
            self.hash = doubled(self.hash[:, :-shift], self.hash[:, shift:]) if self.hash.shape[1] > shift else self.hash[:, :0]
            self.length += shift

    def all(self) -> np.ndarray:
        """Starts of all windows that lie within a text."""
        n = max(len(self.doc) - self.length + 1, 0)
        return np.flatnonzero((self.doc[:n] == self.doc[len(self.doc) - n :]) & self.usable[:n])
