"""64-bit hashes of all words of a text at once."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # odd mixing constants
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Keeps the first n of eight bytes.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def mixed(h: np.ndarray) -> np.ndarray:
    """Bit mixer: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * MULTIPLY[1]
    h = (h ^ (h >> np.uint64(27))) * MULTIPLY[2]
    return h ^ (h >> np.uint64(31))


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII white space."""
    inside = np.zeros(len(text) + 2, dtype=bool)
    np.logical_not(_SPACE[np.frombuffer(text, dtype=np.uint8)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its length and its bytes, eight at a time, each mixed in before the next.
    Words that share a hash under one seed are no likelier than others to share one under another."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    starts, ends = spans(text)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = ends - starts
    eight = np.ndarray(shape=(len(text) + 1,), dtype="<u8", buffer=text + bytes(8), strides=(1,))
    h = mixed(length.astype(np.uint64) * MULTIPLY[0] + np.uint64(seed))
    h = mixed((h ^ (eight[starts] & _FIRST[np.minimum(length, 8)])) * MULTIPLY[0])
    rest, at = np.flatnonzero(length > 8), 8
    while len(rest) and at < _LONG:
        part = eight[starts[rest] + at] & _FIRST[np.minimum(length[rest] - at, 8)]
        h[rest] = mixed((h[rest] ^ part) * MULTIPLY[0])
        at += 8
        rest = rest[length[rest] > at]
    for i in rest.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i]:ends[i]], seed)
    return h
