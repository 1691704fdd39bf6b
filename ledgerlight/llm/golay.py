"""The perfect binary Golay code of length 23: every word is within three bits of one codeword.

Words and codewords are whole numbers; a codeword is known by its twelve message bits. Tables come
from the generator polynomial and are made once per process.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: equal for words with the same error pattern."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        rest = rest ^ np.where(rest >> bit & 1, GENERATOR << (bit - (LENGTH - MESSAGE)), 0)
    return rest


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of at most three bits, and the messages of the codewords at distance
    four from a word with that error, relative to its own codeword's (five for three-bit errors,
    otherwise none, marked 0)."""
    errors = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(LENGTH), n)], np.int64)
    error = np.zeros(1 << (LENGTH - MESSAGE), np.int64)
    error[syndromes(errors)] = errors
    message = np.arange(1 << MESSAGE, dtype=np.int64) << (LENGTH - MESSAGE)
    codewords = message | syndromes(message)
    sevens = codewords[np.bitwise_count(codewords.astype(np.uint64)) == 7]
    near = np.zeros((len(error), 5), np.int64)
    for s, e in enumerate(error.tolist()):
        if e.bit_count() == 3:
            near[s] = sevens[(sevens & e) == e] >> (LENGTH - MESSAGE)
    return error, near


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """n x 6 messages of the codewords within distance four of each word: first the decoded one,
    then the others or, where there are none, the decoded one again.

    Two words that differ in one bit: the decoded codeword of each is among the other's.
    """
    error, near = tables()
    s = syndromes(words)
    own = (words.astype(np.int64) ^ error[s]) >> (LENGTH - MESSAGE)
    return np.concatenate([own[:, None], own[:, None] ^ near[s]], axis=1)
