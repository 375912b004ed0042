"""Substring dedup by words (operator 5).

Rabin-Karp hashes of every window of WINDOW words that may repeat are counted
in Spark; windows that occur twice or more merge into maximal removal intervals
of their text.  A window has 96 bits, a 64-bit and a 32-bit polynomial over two
word hashes of unlike seeds: words that share one hash don't share the other.

Which windows may repeat is decided exactly by :mod:`.anchors`: the least of
the hashes of a window's GRAM-word pieces is counted over the corpus first, and
a window whose anchor occurs once cannot repeat.  Counting is a partial
aggregate, so a window that a third of all documents share is no hot key.

Defined results: null and empty texts have no words; words of a text with an
exact copy go as a whole if there are WINDOW or more; repeated rows are copies
of each other; ties don't matter (all occurrences go); an empty table gives an
empty result; other columns are ignored by :func:`reduced`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import written
from .wordhash import word_hashes

WINDOW = 35
GRAM = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = 0x51ED270B  # seed of the second word hash
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base, and of its inverse modulo 2^64."""
    if not len(_POWERS.get("up", ())) >= n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, from prefix sums."""
    up, down = _powers(len(values) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1])))
    return (prefix[ends] - prefix[starts]) * down[starts]


def _runs(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    return A.mixed(_spans(values, at, at + width))


def _anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grams = _runs(hashes, GRAM)
    place, first, last = A.window_anchors(grams, WINDOW - GRAM + 1)
    return grams[place], place, first, last


def _measure(text: bytes) -> tuple[int, bytes, np.ndarray]:
    hashes = word_hashes(text)
    return len(hashes), b" ".join(text.split()), _anchors(hashes)[0]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows whose anchor occurs twice or more."""
    for b in batches:
        for rid, text, at in zip(b.column("rid").to_pylist(), b.column("text"), b.column("at"), strict=True):
            text = bytes(text.as_buffer())
            hashes = word_hashes(text)
            _, _, first, last = _anchors(hashes)
            which = np.asarray(at.values.to_numpy(zero_copy_only=False), dtype=np.int64)
            lengths = last[which] - first[which] + 1
            start = np.repeat(first[which] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            one, two = _runs(hashes, WINDOW)[start], _runs(word_hashes(text, _SECOND), WINDOW)[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(start), rid)), pa.array(start.astype(np.int32)), pa.array(one.view(np.int64)),
                 pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["rid", "start", "h1", "h2"])


def cut_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], int, int]:
    """Kept words, number of removed words, number of removed runs."""
    tokens = text.split()
    starts, ends = A.merged(starts, ends)
    kept, at = [], 0
    for a, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept += tokens[at:a]
        at = e
    return kept + tokens[at:], int((ends - starts).sum()), len(starts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rid, text, at in zip(b.column("rid").to_pylist(), b.column("text"), b.column("starts"), strict=True):
            starts = np.asarray(at.values.to_numpy(zero_copy_only=False), dtype=np.int64)
            kept, removed, runs = cut_words(bytes(text.as_buffer()), starts, starts + WINDOW)
            out.append((rid, removed, runs, hashlib.sha256(b" ".join(kept)).digest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["rid", "n_removed", "n_spans", "digest"])


def repeated_windows(docs: DataFrame) -> tuple[A.Candidates, DataFrame]:
    """The candidates, and (rid, starts) with the windows that repeat in texts without an exact copy."""
    c = A.candidates(docs, _measure, hot_at=1 << 62)
    windows = c.texts.select("rid", F.encode("text", "UTF-8").alias("text"), "at").mapInArrow(
        _windows, "rid long, start int, h1 long, h2 int")
    spans = A.repeated(windows, ["h1", "h2"], WINDOW)
    return c, spans.groupBy("rid").agg(F.collect_list("start").alias("starts"))


def reduced(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 of every row."""
    c, starts = repeated_windows(docs)
    single = c.texts.where("copies = 1").select("rid", F.encode("text", "UTF-8").alias("text"))
    cut = single.join(starts, "rid").mapInArrow(_cut, "rid long, n_removed long, n_spans long, digest binary")
    return A.summary(c, cut, WINDOW, b"").withColumnRenamed("size", "n_words")
