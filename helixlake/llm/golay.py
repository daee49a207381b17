"""The perfect binary Golay code of length 23, as fuzzy hash keys.

Every 23-bit word lies within distance 3 of exactly one code word.  `keys` lists all code words within distance 4
(one, or six where the nearest is at distance 3).  Words at distance 2 or less share a key: the word half-way
between them is at distance 3 or less of its own code word, which is then within 4 of both.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11


def syndrome(word: np.ndarray) -> np.ndarray:
    rest = word.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - CHECK), 0)
    return rest


@cache
def near() -> np.ndarray:
    """For each syndrome the error patterns of weight 4 or less that have it, filled up with -1."""
    patterns = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(LENGTH), w)], dtype=np.int64)
    found = syndrome(patterns)
    order = np.argsort(found, kind="stable")
    patterns, found = patterns[order], found[order]
    first = np.searchsorted(found, np.arange(1 << CHECK))
    rank = np.arange(len(found)) - first[found]
    out = np.full((1 << CHECK, rank.max() + 1), -1, dtype=np.int64)
    out[found, rank] = patterns
    return out


def keys(words: np.ndarray) -> np.ndarray:
    """A row for each word: the 12-bit numbers of the code words within distance 4, filled up with -1."""
    errors = near()[syndrome(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> CHECK, -1)
