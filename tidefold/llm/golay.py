"""The perfect binary Golay code: nearby codewords of 23-bit words."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR, LENGTH, CHECKS = 0xAE3, 23, 11


def _syndrome(word: int) -> int:
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes by (byte of the word, its value), and the error of at most 3 bits for each syndrome."""
    by_byte = np.array([[_syndrome(v << 8 * b & (1 << LENGTH) - 1) for v in range(256)] for b in range(3)], np.int64)
    errors = np.zeros(1 << CHECKS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            errors[_syndrome(e)] = e
    return by_byte, errors


_SYNDROMES, _ERRORS = _tables()


def decoded(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within 3 bits of each 23-bit word."""
    s = _SYNDROMES[0][words & 255] ^ _SYNDROMES[1][words >> 8 & 255] ^ _SYNDROMES[2][words >> 16]
    return (words ^ _ERRORS[s]) >> CHECKS


def nearby(words: np.ndarray, bits: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each word and of its neighbours by one of the low `bits` bits.

    A word within 2 of its codeword has that index alone, others have 6 of 23 bits. Words that differ in at most 2 of the low
    `bits` bits share an index: that of a word between them.
    """
    flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
    near = np.sort(decoded(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(new)
    return row, near[row, col]
