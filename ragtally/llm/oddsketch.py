"""Kernels of the MinHash near-duplicate operator (11): shingle sets, MinHash samples, bands, odd sketches.

A set is the sorted 64-bit hashes of a text's distinct shingles: the words' hashes, four of them mixed by
multiplications and shifts, so equal word sequences and no others (but for chance, 2^-64 a pair) are equal.

SAMPLES MinHash values describe a set.  The first BANDS * ROWS of them, ROWS at a time, are the band keys.  All of
them are folded into an odd sketch: (place, value) of each sample flips one of BITS bits.  The exclusive-or of two
sketches is the sketch of the samples in which two sets differ, so its population count grows with 1 - similarity:
2 * SAMPLES * (1 - J) flips are expected, and a count c stands for -BITS / 2 * ln(1 - 2c / BITS) of them.
"""

from __future__ import annotations

import math

import numpy as np

from .wordhash import MULTIPLY, mixed, word_hashes

SHINGLE = 4
SAMPLES = 256
BANDS = 32
ROWS = 4
BITS = 1024
#: Chance that the sketches of a pair at the least similarity refuse it.
REFUSED = 1e-10

_CHUNK = 256  # rows of a table of SAMPLES columns that stays in cache


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    w = word_hashes((text or "").encode().lower())  # bytes: only A-Z change, only ASCII white space separates
    if not len(w):
        return w
    k = min(shingle, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = mixed((h ^ w[j:j + n]) * MULTIPLY[0])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, SAMPLES + 1, dtype=np.uint64)
    return mixed(at * MULTIPLY[0]), mixed(at * MULTIPLY[1]) | np.uint64(1)


_FLIP, _FACTOR = _seeds()


def samples(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a set that is not empty: the least of a family of mixed hashes."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK, None] ^ _FLIP
        part *= _FACTOR
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of samples; bands have keys of their own."""
    rows = least[:BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = mixed((h ^ rows[:, j]) * MULTIPLY[0])
    return h


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The samples' parities: BITS bits, as 64-bit words."""
    bit = mixed(least ^ _FACTOR) % np.uint64(BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def estimate(count: int) -> float:
    """Similarity that a population count of the exclusive-or of two sketches stands for."""
    share = min(2 * count / BITS, 1 - 1 / BITS)
    return 1 + BITS / (4 * SAMPLES) * math.log(1 - share)


def most_bits(least: float = 0.8, refused: float = REFUSED) -> int:
    """Largest population count that a pair of similarity `least` or more reaches but for a chance of `refused`.

    The samples that differ are binomial; each flips two bits; the number of odd bits after m flips has a known
    mean and variance and is taken as normal."""
    d = np.arange(SAMPLES + 1)
    log_choose = np.array([math.lgamma(SAMPLES + 1) - math.lgamma(i + 1) - math.lgamma(SAMPLES - i + 1) for i in d])
    chance = np.exp(log_choose + d * math.log(1 - least) + (SAMPLES - d) * math.log(least))
    q1, q2 = (1 - 2 / BITS) ** (2 * d), (1 - 4 / BITS) ** (2 * d)
    mean = BITS * (1 - q1) / 2
    spread = np.sqrt(np.maximum(BITS / 4 * (1 - q2) + BITS ** 2 / 4 * (q2 - q1 ** 2), 1e-9))
    for count in range(BITS):
        over = [0.5 * math.erfc((count + 0.5 - m) / s / math.sqrt(2)) for m, s in zip(mean, spread, strict=True)]
        if float(np.dot(chance, over)) <= refused:
            return count
    return BITS
