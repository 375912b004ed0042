"""SimHash near-duplicates (operator 4).

Fingerprints: XXH64 (seed 42) of every shingle of four words of the lower-cased
text; a bit is 1 if set in over half of the hashes.  Computed in Arrow batches.

Links: all pairs of distinct fingerprints at most RADIUS bits apart, by tiled
exact comparison.  Distinct fingerprints are sorted by population count and cut
into blocks of BLOCK; block pairs are formed by an equi-join on the population
counts that a block has or reaches, so pairs whose counts differ by more than
the radius never meet.  A block pair is compared in tiles with NumPy
exclusive-or and bit counts, again leaving out columns whose counts are too far.
A tile pair's links are reduced to a spanning forest before they leave the
task, so a group of many near copies gives a row per member, not per pair.

Components: alternating large-star and small-star joins over the forest edges.
Copies are one fingerprint, hence one node.

Work grows with the square of the number of distinct fingerprints (the method
compares all of near population count); blocks keep memory bounded.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null doc_id takes the component of its fingerprint (null only if no
member has an id); repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored by :func:`components` and kept by
:func:`survivors`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import null_safe_join, numbered, smallest_reachable, text_of, written

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 8192
TILE = 128


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash (unsigned) of a text."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(tokens))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        keep = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(fp, pa.int64())], names=keep + ["fp"])


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the trees of linked nodes (u, v); parent holds each node's root before and after."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within `a` (b None), or between a and b: two arrays of linked values.
    Both arrays are sorted by population count."""
    nodes = a if b is None else np.concatenate((a, b))
    cols, shift = (a, 0) if b is None else (b, len(a))
    pa_, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(cols).astype(np.int64)
    parent = np.arange(len(nodes))
    for i in range(0, len(a), TILE):
        rows = a[i:i + TILE]
        lo = np.searchsorted(pb, pa_[i] - radius, "left")
        hi = np.searchsorted(pb, pa_[i + len(rows) - 1] + radius, "right")
        lo = max(lo, i + 1) if b is None else lo
        if lo >= hi:
            continue
        near = np.bitwise_count(rows[:, None] ^ cols[None, lo:hi]) <= radius
        if near.any():
            r, c = np.nonzero(near)
            parent = _forest(parent, r + i, c + lo + shift)
    own = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[own], nodes[parent[own]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def values(x) -> np.ndarray:
        v = np.asarray(x.values.to_numpy(), dtype=np.int64).view(np.uint64)
        return v[np.argsort(np.bitwise_count(v), kind="stable")]

    for batch in batches:
        for i, j, left, right in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(),
                                     batch.column("left"), batch.column("right"), strict=True):
            u, v = linked(values(left), None if i == j else values(right))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links between distinct fingerprints `fp`."""
    pop = F.bit_count("fp")
    blocks = (numbered(fingerprints.select("fp", pop.alias("pop")), [F.col("pop"), F.col("fp")], "n")
              .groupBy(F.floor(F.col("n") / BLOCK).alias("block"))
              .agg(F.min("pop").alias("low"), F.max("pop").alias("high"), F.collect_list("fp").alias("fps")))
    blocks = written(blocks, "blocks")
    has = blocks.select(F.col("block").alias("i"), F.explode(F.sequence("low", "high")).alias("pop"))
    reaches = blocks.select(F.col("block").alias("j"),
                            F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("pop"))
    pairs = has.join(reaches, "pop").where("i <= j").select("i", "j").distinct()
    pairs = pairs.join(blocks.select(F.col("block").alias("i"), F.col("fps").alias("left")), "i").join(
        blocks.select(F.col("block").alias("j"), F.col("fps").alias("right")), "j")
    n = blocks.count()
    return pairs.repartition(max(1, min(20_000, n * (n + 1) // 4)), "i", "j").mapInArrow(_compare, "a long, b long")


def _fingerprinted(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()))
    fps = docs.select("doc_id", key.alias("row_key"), text_of().alias("text")).mapInArrow(
        _fingerprint_batches, "doc_id long, row_key string, fp long")
    return written(fps, "fingerprints")


def _grouped(rows: DataFrame) -> DataFrame:
    """(fp, component): component is one fingerprint of the group."""
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = smallest_reachable(links(own))
    return own.join(found, own["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64-bit), component_id (smallest doc_id reachable) for every row."""
    rows = _fingerprinted(docs)
    nodes = written(_grouped(rows), "nodes")
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(nodes.join(ids, "component").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group (that of the smallest doc_id), with all its columns."""
    rows = _fingerprinted(docs)
    nodes = written(_grouped(rows), "nodes")
    first = rows.join(nodes.select("fp", "component"), "fp").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()))
    columns = docs.columns
    keep = first.select(F.col("first.row_key").alias("__key"))
    return docs.select(F.struct(*columns).alias("__doc"), key.alias("__key")).join(keep, "__key", "left_semi").dropDuplicates(
        ["__key"]).select("__doc.*")
