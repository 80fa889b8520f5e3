"""The perfect binary Golay code [23, 12]: covering radius 3."""

from __future__ import annotations

import itertools

import numpy as np

# Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS, RADIUS = 23, 11, 3


def _residue(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def syndromes(words: np.ndarray) -> np.ndarray:
    """The residue of each 23-bit word; it is linear, so the bits' residues add up."""
    out = np.zeros(words.shape, np.int64)
    for bit in range(LENGTH):
        out ^= np.where(words >> bit & 1, _residue(1 << bit), 0)
    return out


def patterns(excess: int) -> np.ndarray:
    """By syndrome, the error patterns that lead to codewords at the covering radius plus ``excess``.

    excess 0 takes the whole radius (one pattern each: the code is perfect).
    Rows are padded with -1.
    """
    weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
    masks = np.array([sum(1 << b for b in bits) for w in weights for bits in itertools.combinations(range(LENGTH), w)], np.int64)
    of = syndromes(masks)
    width = np.bincount(of, minlength=1 << CHECK_BITS).max()
    table = np.full((1 << CHECK_BITS, width), -1, np.int64)
    order = np.argsort(of, kind="stable")
    sorted_of = of[order]
    first = np.searchsorted(sorted_of, sorted_of)
    table[sorted_of, np.arange(len(order)) - first] = masks[order]
    return table
