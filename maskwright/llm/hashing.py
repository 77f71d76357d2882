"""Word and shingle hashes of UTF-8 texts, computed on whole byte arrays.

A word's hash is a polynomial over a table of random 64-bit values, read off prefix products, so a
text costs a fixed number of array passes however many words it has.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS = _powers(_BASE)
_INVERSE = pow(_BASE, -1, 1 << 64)
_INVERSES = _powers(_INVERSE)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_EXACT = np.where(SPACES, np.uint64(0), _BYTE)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_STEP = _SEED.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 0x09 to 0x0D."""
    inside = np.zeros(len(buf) + 2, np.int8)
    np.logical_not(SPACES[buf], out=inside[1:-1].view(bool))
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(buf: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """One 64-bit hash for each word; fold_case takes A-Z as a-z."""
    starts, _ = word_spans(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = (_FOLDED if fold_case else _EXACT)[buf]
    for block in range(0, len(buf), _BLOCK):
        part = values[block : block + _BLOCK]
        part *= _POWERS[: len(part)]
        if block:
            part *= np.uint64(pow(_BASE, block, 1 << 64))
    out = np.add.reduceat(values, starts) * _INVERSES[starts % _BLOCK]
    if len(buf) > _BLOCK:
        scale = np.array([pow(_INVERSE, block, 1 << 64) for block in range(0, len(buf), _BLOCK)], np.uint64)
        out *= scale[starts // _BLOCK]
    return mix(out)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z taken as a-z.

    Fewer words than that make one shingle, none make an empty set.
    """
    found = word_hashes(np.frombuffer((text or "").encode(), np.uint8), fold_case=True)
    if not len(found):
        return found
    size = min(words, len(found))
    total = np.full(len(found) - size + 1, (size * 0x5851F42D4C957F2D) & _MASK, np.uint64)
    for j in range(size):
        total += found[j : len(found) - size + 1 + j] * _STEP[j]
    return np.unique(mix(total))
