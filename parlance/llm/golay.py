"""The binary Golay code of length 23: every 23-bit word is within 3 bits of one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, as the code is usually given


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator polynomial, 11 bits."""
    rest = words.astype(np.uint32).copy()
    for bit in range(BITS - 1, 10, -1):
        rest ^= ((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return rest


@cache
def _errors() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2048 syndromes."""
    patterns = [sum(1 << i for i in c) for n in range(4) for c in combinations(range(BITS), n)]
    table = np.zeros(1 << 11, np.uint32)
    words = np.array(patterns, np.uint32)
    table[_syndrome(words)] = words
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    words = words.astype(np.uint32)
    return (words ^ _errors()[_syndrome(words)]) >> np.uint32(11)


def nearby(words: np.ndarray) -> np.ndarray:
    """(24, n): the index for each word as it is, then with each of its bits turned over.

    Two words that differ in two bits share an index here: the word half way between
    them is one bit from either.
    """
    return np.stack([decode(words), *(decode(words ^ np.uint32(1 << i)) for i in range(BITS))])
