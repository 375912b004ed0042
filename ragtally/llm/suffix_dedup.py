"""Suffix-array dedup of byte strings (operator 1).

Every byte covered by a SIZE-byte string that also starts elsewhere goes.

1. :mod:`.anchors` finds, exactly, where strings may repeat: the least of the
   hashes of a string's GRAM-byte pieces must occur twice or more.
2. For every such anchor, the bytes of all strings that it anchors (at most
   2 * SIZE - GRAM) go to the anchor's group: a collection of short documents,
   aligned at the anchor.
3. Each collection is built column-wise: from the last column to the first,
   one symbol per document is inserted each round, which moves the documents
   from their order by the suffix behind the column to that by the suffix at
   it (a stable sort by the inserted symbol: the column's Burrows-Wheeler
   step) and updates the longest common prefix of neighbours (one more than
   the least prefix between them before).  Columns are written to an external
   file once, in round order, and read sequentially.  A string repeats if a
   neighbour shares SIZE bytes with it.

Only suffixes at the same distance from an anchor are compared (the positional
form of the collection transform).  Equal strings always are at the same
distance from equal anchors, so the result is that of the full suffix array;
inserting a symbol among the suffixes of all lengths instead would take work in
the square of a document's length.

Hot anchors: strings of an anchor that occurs more than HOT_AT times are
counted by 128-bit digests (combined before the shuffle) rather than gathered
in one task; same result.

Defined results: null text is empty; a text shorter than SIZE keeps all bytes;
exact copies of SIZE bytes or more go as a whole, repeated rows being copies;
an empty table gives an empty result; other columns are ignored by
:func:`reduced` and kept by :func:`deduplicated`.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import text_of, written

SIZE = 400
GRAM = 32
HOT_AT = 100_000
BATCH = 16_384  # documents of a collection batch; a larger group is one batch
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: bytes) -> np.ndarray:
    """Hash of each run of GRAM bytes, by doubling."""
    h = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    width, base = 1, _BASE
    while width < GRAM:
        if len(h) <= width:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-width] * base + h[width:]
        base = np.uint64(int(base) ** 2 % (1 << 64))
        width *= 2
    return A.mixed(h)


def _anchors(text: bytes, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(text) < size:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    grams = _grams(text)
    place, first, last = A.window_anchors(grams, size - GRAM + 1)
    return grams[place], place, first, last


def _measure(size: int):
    return lambda text: (len(text), text, _anchors(text, size)[0])


def _collect(size: int):
    """The bytes of all strings of each anchor that may repeat; for hot anchors a digest per string."""
    names = ["hash", "rid", "start", "anchor", "bytes", "digest"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, text, at, hot in zip(b.column("rid").to_pylist(), b.column("text"), b.column("at"), b.column("hot"),
                                          strict=True):
                data = bytes(text.as_buffer())
                hashes, place, first, last = _anchors(data, size)
                for j in at.as_py():
                    a, e = int(first[j]), int(last[j])
                    rows.append((int(hashes[j].view(np.int64)), rid, a, int(place[j]) - a, data[a:e + size], None))
                for j in hot.as_py():
                    for s in range(int(first[j]), int(last[j]) + 1):
                        rows.append((0, rid, s, 0, None, xxhash.xxh3_128_digest(data[s:s + size])))
                if len(rows) >= 8192:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
    return run


def column_matches(strings: list[bytes], anchor: np.ndarray, group: np.ndarray, size: int = SIZE
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction over strings aligned at their anchors; `group` is non-decreasing.  Returns, per
    string, the first and last place (relative to the anchor) at which it shares `size` bytes with another
    string of its group; first > last: none."""
    m = len(strings)
    length = np.array([len(s) for s in strings], dtype=np.int64)
    right, left = length - anchor, -anchor
    top, bottom = int(right.max()), int(left.min())
    none = np.int64(1 << 40)
    first, last = np.full(m, none), np.full(m, -none)
    with tempfile.TemporaryFile() as file:
        file.truncate((top - bottom) * m)
        columns = np.memmap(file, dtype=np.uint8, mode="r+", shape=(top - bottom, m))
        for i in range(0, m, 4096):  # row r holds the symbols of column top - 1 - r
            block = np.zeros((min(4096, m - i), top - bottom), dtype=np.uint8)
            for k, s in enumerate(strings[i:i + 4096]):
                at = left[i + k] - bottom
                block[k, at:at + len(s)] = np.frombuffer(s, dtype=np.uint8)
            columns[:, i:i + 4096] = block[:, ::-1].T
        order, base = np.arange(m), group.astype(np.int64) * 257
        prefix = np.zeros(m + 1, dtype=np.int32)  # of each document and the one before it in order
        for r in range(top - bottom):
            t = top - 1 - r
            symbol = np.where((t < right) & (t >= left), columns[r].astype(np.int64) + 1, 0)[order]
            key = base + symbol
            if (key[1:] >= key[:-1]).all():
                same = (key[1:] == key[:-1]) & (symbol[1:] > 0)
                prefix[1:m] = np.where(same, prefix[1:m] + 1, 0)
            else:
                by = np.argsort(key, kind="stable")
                key, symbol, order = key[by], symbol[by], order[by]
                same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] > 0))
                lo, hi = by[same] + 1, by[same + 1]
                new = np.zeros(m + 1, dtype=np.int32)
                new[same + 1] = prefix[hi] + 1
                far = np.flatnonzero(hi > lo)
                if len(far):
                    cuts = np.column_stack((lo[far], hi[far] + 1)).ravel()
                    new[same[far] + 1] = np.minimum.reduceat(prefix, cuts)[::2] + 1
                prefix = new
            if t + size <= top:
                long = prefix >= size
                if long.any():
                    who = order[long[:-1] | long[1:]]
                    first[who] = t
                    last[who] = np.maximum(last[who], t)
        del columns
    return first, last


def _match(size: int):
    """Runs the construction over whole anchor groups; input is sorted by anchor hash."""
    names = ("hash", "rid", "start", "anchor", "bytes")

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        h = np.array([r[0] for r in rows], dtype=np.int64)
        group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        many = np.bincount(group)[group] > 1
        rows = [r for r, keep in zip(rows, many.tolist(), strict=True) if keep]
        out = [np.zeros(0, np.int64)] * 3
        if rows:
            rid, start, anchor = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))
            first, last = column_matches([r[4] for r in rows], anchor, group[many], size)
            hit = first <= last
            out = [rid[hit], (start + anchor + first)[hit], (start + anchor + last)[hit] + size]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(*(b.column(n).to_pylist() for n in names), strict=True)
            if len(rows) >= BATCH and rows[0][0] != rows[-1][0]:
                cut = len(rows)
                while rows[cut - 1][0] == rows[-1][0]:  # the last group may go on
                    cut -= 1
                yield spans(rows[:cut])
                rows = rows[cut:]
        if rows:
            yield spans(rows)
    return run


def repeated_spans(docs: DataFrame, size: int = SIZE) -> tuple[A.Candidates, DataFrame]:
    """The candidates, and (rid, spans) with the byte intervals that repeat."""
    c = A.candidates(docs, _measure(size), HOT_AT)
    strings = c.texts.select("rid", F.encode("text", "UTF-8").alias("text"), "at", "hot").mapInArrow(
        _collect(size), "hash long, rid long, start int, anchor int, bytes binary, digest binary")
    strings = written(strings, "strings")
    found = (strings.where("bytes is not null").drop("digest").repartition("hash").sortWithinPartitions("hash")
             .mapInArrow(_match(size), "rid long, start long, end long"))
    hot = A.repeated(strings.where("digest is not null").select("rid", F.col("start").cast("long").alias("start"), "digest"),
                     ["digest"], size)
    return c, found.union(hot).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def cut_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """Kept bytes, number of removed bytes, number of maximal removed runs."""
    starts, ends = A.merged(starts, ends)
    kept, at = [], 0
    for a, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:a])
        at = e
    return b"".join([*kept, text[at:]]), int((ends - starts).sum()), len(starts)


def _bounds(spans) -> tuple[np.ndarray, np.ndarray]:
    values = spans.values
    return tuple(np.asarray(values.field(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in (0, 1))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rid, text, spans in zip(b.column("rid").to_pylist(), b.column("text"), b.column("spans"), strict=True):
            kept, removed, runs = cut_bytes(bytes(text.as_buffer()), *_bounds(spans))
            out.append((rid, removed, runs, hashlib.sha256(kept).digest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["rid", "n_removed", "n_spans", "digest"])


def reduced(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    c, spans = repeated_spans(docs)
    single = c.texts.where("copies = 1").select("rid", F.encode("text", "UTF-8").alias("text"))
    cut = single.join(spans, "rid").mapInArrow(_cut, "rid long, n_removed long, n_spans long, digest binary")
    return A.summary(c, cut, SIZE, b"").withColumnRenamed("size", "n_bytes")


def cut_text(text: str, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the bytes of the spans; a character goes only if all of its bytes go."""
    data = text.encode()
    starts, ends = A.merged(starts, ends)
    kept, at = [], 0
    for a, e in zip(starts.tolist(), ends.tolist(), strict=True):
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if a < e:
            kept.append(data[at:a])
            at = e
    return b"".join([*kept, data[at:]]).decode()


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [cut_text(t, *_bounds(s)) if s.is_valid else t
                 for t, s in zip(b.column("text").to_pylist(), b.column("spans"), strict=True)]
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents with repeated strings of `size` bytes cut out of their texts (whole characters only); n_chars,
    if there, is set anew.  All rows stay, a text that goes as a whole is empty, a null text stays null."""
    c, spans = repeated_spans(docs, size)
    cuts = c.prints.select("rid", "row_key", "text_key", "size").join(c.groups.drop("rid"), "text_key")
    cuts = cuts.join(spans, "rid", "left").groupBy("row_key").agg(
        F.max((F.col("copies") > 1) & (F.col("size") >= size)).alias("whole"), F.first("spans", True).alias("spans"))
    cuts = cuts.where("whole or spans is not null")
    columns = docs.columns
    doc = docs.select(F.struct(*columns).alias("__doc"), F.unhex(A.row_key()).alias("row_key"))
    d = doc.join(cuts, "row_key", "left").select(
        "__doc", F.when(F.col("whole"), F.when(F.col("__doc.text").isNotNull(), "")).otherwise(F.col("__doc.text")).alias("text"),
        F.when(~F.col("whole"), F.col("spans")).alias("spans"))
    schema = d.select("__doc", "text", "spans").schema
    d = d.mapInArrow(_cut_texts, schema)
    out = d.withColumn("__doc", F.col("__doc").withField("text", F.col("text")))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("__doc", F.col("__doc").withField("n_chars", F.length("text").cast(kind)))
    return out.select("__doc.*")
