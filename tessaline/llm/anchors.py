"""Strings sampled from windows by their content.

A window is ``width`` consecutive tokens of one document. Of the ``gram``-token strings within it, the one with the least hash
is its anchor (the leftmost of equal ones), which depends on the window's content alone, so equal windows have equal anchors
at equal offsets, and windows that share an anchor need one entry only.
"""

from __future__ import annotations

import numpy as np

from .blocks import U64, mix

_BASE = U64(0x9E3779B97F4A7C15 | 5)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: Random 64-bit values of the bytes.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]
#: Low bits of the ordering value that hold a position; a chunk has fewer tokens.
PLACE_BITS = 24
CHUNK = 1 << 18


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(2 * n, b, U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


class Hashes:
    """Hashes of any spans of an array of 64-bit symbols, from prefix sums of a polynomial modulo 2 to the 64."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _power(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if rest := width - size:
        values = np.minimum(values[:-rest], values[rest:])
    return values


def anchors(pieces: list[np.ndarray], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, piece, first window, further windows) of every anchor of the pieces."""
    lens = np.array([len(p) for p in pieces])
    symbols = np.concatenate(pieces)
    assert len(symbols) < 1 << PLACE_BITS
    if len(symbols) < width:
        return tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64))
    piece_of, first = np.repeat(np.arange(len(pieces)), lens), np.cumsum(lens) - lens
    h = Hashes(symbols)
    grams = h.grams(gram)
    order = (grams & U64(-1 << PLACE_BITS & (1 << 64) - 1)) | np.arange(len(grams), dtype=U64)
    chosen = (sliding_min(order, width - gram + 1) & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    chosen[piece_of[: len(chosen)] != piece_of[width - 1 :]] = -1  # windows across documents are none
    change = np.flatnonzero(np.diff(chosen)) + 1
    lo = np.concatenate([[0], change])
    hi = np.concatenate([change, [len(chosen)]]) - 1
    keep = chosen[lo] >= 0
    lo, hi = lo[keep], hi[keep]
    return grams[chosen[lo]], piece_of[lo], lo - first[piece_of[lo]], hi - lo
