"""Candidates for repeated windows: shared by the suffix (1) and the substring (5) operator.

A window (a fixed number of consecutive symbols) contains many k-grams; the one
of least hash is its anchor.  Equal windows have equal anchors at the same
place, so a window can only repeat if its anchor's hash occurs twice or more.
Anchors are few (about two per window length), so they can be counted over the
whole corpus at little cost, and everything after that sees only the texts and
windows that may repeat.  The filter is exact: it drops nothing that repeats.

Exact copies are counted by the digest of the whole text and only one of them
goes on: every window of a text that occurs twice repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import text_of, written

_POSITION_BITS = 28


def mixed(h: np.ndarray) -> np.ndarray:
    """Bit mixer (fixed 64-bit finalizer constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_anchors(grams: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of every run of `per_window` k-gram hashes: (place of the anchor, first window, last window),
    one entry for each run of windows that share an anchor; the leftmost of equal hashes counts."""
    n = len(grams) - per_window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    if len(grams) >> _POSITION_BITS:
        raise ValueError("a text is longer than 2^28 symbols")
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= per_window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = per_window - width
    least = np.minimum(least[:n], least[rest:rest + n])
    place = (least & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.concatenate((first[1:], [n])) - 1
    return place[first], first, last


@dataclass
class Candidates:
    """prints: doc_id, rid, row_key, text_key, size, digest (kept hash if nothing goes), hashes;
    groups: text_key, copies, rid (one row of the group);
    texts: rid, copies, text, at (ordinals of the anchors that occur twice or more), hot (those among them
    that occur more than `hot_at` times)."""

    prints: DataFrame
    groups: DataFrame
    texts: DataFrame


def row_key() -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()))


def candidates(docs: DataFrame, measure: Callable[[bytes], tuple[int, bytes, np.ndarray]], hot_at: int) -> Candidates:
    """`measure(text)` gives a text's size in symbols, what is hashed if nothing is removed, and its anchors' hashes."""
    ship_package(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_buffer() if x.is_valid else b"" for x in b.column("text").cast(pa.binary())]
            sizes, digests, hashes, lengths = [], [], [], [0]
            for t in texts:
                size, whole, found = measure(bytes(t))
                sizes.append(size)
                digests.append(hashlib.sha256(whole).digest())
                hashes.append(found.view(np.int64))
                lengths.append(lengths[-1] + len(found))
            values = pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), b.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)],
                names=["doc_id", "row_key", "text_key", "size", "digest", "hashes"])

    keyed = docs.select("doc_id", F.unhex(row_key()).alias("row_key"), F.unhex(F.md5(text_of())).alias("text_key"),
                        text_of().alias("text"))
    prints = keyed.mapInArrow(read, "doc_id long, row_key binary, text_key binary, size long, digest binary, "
                                    "hashes array<bigint>")
    # the number is only used once it is in the written table
    prints = written(prints.withColumn("rid", F.monotonically_increasing_id()), "prints")
    groups = written(prints.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("rid").alias("rid")), "groups")
    anchors = prints.select("rid", "row_key", "hashes").join(groups.select("rid", "copies"), "rid")
    places = anchors.select("rid", F.posexplode("hashes").alias("at", "hash"))
    # written, so that the join below reads plain exchanges and a hot hash can be split among tasks
    often = written(places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "often")
    found = places.join(often, "hash").groupBy("rid").agg(
        F.collect_list(F.when(F.col("n") <= hot_at, F.col("at"))).alias("at"),
        F.collect_list(F.when(F.col("n") > hot_at, F.col("at"))).alias("hot"))
    found = anchors.select("rid", "row_key", "copies").join(found, "rid")
    texts = docs.select(F.unhex(row_key()).alias("row_key"), text_of().alias("text")).join(found, "row_key")
    return Candidates(prints, groups, written(texts.drop("row_key"), "texts"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals [start, end)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


def repeated(windows: DataFrame, digest: list[str], size: int) -> DataFrame:
    """Spans of the windows (rid, start, digest columns) whose digest occurs twice or more: rid, start, end.
    Counts are combined before the shuffle; they are written, so that the join back reads plain exchanges and
    hot digests can be split among tasks."""
    often = written(windows.groupBy(*digest).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "often")
    return windows.join(often, digest).select("rid", "start", (F.col("start") + size).alias("end"))


def summary(c: Candidates, cut: DataFrame, least: int, empty: bytes) -> DataFrame:
    """One row per document from `cut` (rid, n_removed, n_spans, digest): doc_id, size, n_removed, n_spans,
    kept_sha256.  A text of `least` symbols or more with a copy goes as a whole."""
    per_text = c.groups.join(cut.withColumnRenamed("digest", "cut_digest"), "rid", "left").drop("rid")
    d = c.prints.select("doc_id", "text_key", "size", "digest").join(per_text, "text_key")
    whole = (F.col("copies") > 1) & (F.col("size") >= least)
    pick = lambda all_, part, none: F.when(whole, all_).when(F.col("cut_digest").isNotNull(), part).otherwise(none)
    return d.select(
        "doc_id", "size", pick(F.col("size"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(pick(F.lit(hashlib.sha256(empty).digest()), F.col("cut_digest"), F.col("digest")))).alias("kept_sha256"))
