"""Greedy packing of lines into chunks under a token budget.

A chunk takes whole lines while they fit; the line that doesn't opens the next
chunk.  Only a line above the budget is split, into pieces of the budget and a
rest, which are packed like lines.

A document's lines are held in blocks of neighbouring positions, a row each, so
no task needs a whole document.  A block turns the fill of the chunk that is
open before it into that after it, and closes a number of chunks; both are
tables over all fills 0 ... budget.  Tables of neighbouring blocks compose, so
the fill before each block comes from pointer doubling: after round r a block's
table covers 2^r blocks, and log2(blocks of the longest document) rounds
suffice.  A document of one block needs none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Lines that are held as Python objects at once (a block of more is held whole).
LINES = 1 << 14

_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def pieces(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, first and end word of each piece: one a line, or several of a line above the budget."""
    n = np.maximum(1, -(-sizes // budget))
    line = np.repeat(np.arange(len(sizes)), n)
    first = (np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)) * budget
    return line, first, np.minimum(first + budget, sizes[line])


def transition(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fill 0 ... budget of the open chunk: its fill after pieces of these sizes, and the chunks closed."""
    upto = np.cumsum(sizes)
    before = upto - sizes
    follow = np.searchsorted(upto, before + budget, side="right")  # the piece that opens the chunk after one opened here
    n, total = len(sizes), int(upto[-1]) if len(sizes) else 0
    fill, closed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = follow[i]
        fill[i], closed[i] = (total - before[i], 0) if j == n else (fill[j], closed[j] + 1)
    fills = np.arange(budget + 1)
    cut = np.searchsorted(upto, budget - fills, side="right")  # the first piece that doesn't fit
    whole = cut == n
    return np.where(whole, fills + total, fill[cut]), np.where(whole, 0, closed[cut] + 1)


def chunk_numbers(sizes: np.ndarray, budget: int, fill: int = 0, chunk: int = 0) -> np.ndarray:
    """Chunk of each piece, `chunk` being open and filled with `fill` words before the first."""
    upto = np.cumsum(sizes)
    before, out = upto - sizes, np.full(len(sizes), chunk, dtype=np.int64)
    i = int(np.searchsorted(upto, budget - fill, side="right"))
    while i < len(sizes):
        chunk += 1
        j = int(np.searchsorted(upto, before[i] + budget, side="right"))
        out[i:j] = chunk
        i = j
    return out


def slices(b: pa.RecordBatch, column: str, most: int = LINES) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of the batch whose lists have at most `most` entries together, at least a row each."""
    upto, lo = np.cumsum(b.column(column).value_lengths().to_numpy(zero_copy_only=False)), 0
    while lo < b.num_rows:
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


class _Transitions:
    """(doc, place, sizes) -> the block's table."""

    def __init__(self, doc: str, budget: int):
        self.doc, self.budget = doc, budget

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fills, closed = [], []
            for s in b.column("sizes"):
                _, first, end = pieces(np.asarray(s.values.to_numpy(zero_copy_only=False), np.int64), self.budget)
                f, c = transition(end - first, self.budget)
                fills.append(f)
                closed.append(c)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(self.doc), b.column("place"), pa.array(fills, longs), pa.array(closed, longs)],
                                             names=[self.doc, "place", "fills", "closed"])


class _Pack:
    """A block's parts of its chunks, from the fill and number of the chunk open before it."""

    def __init__(self, doc: str, budget: int):
        self.doc, self.budget = doc, budget

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "items")):
            at, rows = [], []
            for i, (block, fill, chunk, items) in enumerate(zip(*[b.column(c).to_pylist() for c in (
                    "block", "fill", "chunk", "items")], strict=True)):
                line, first, end = pieces(np.array([x["n"] for x in items], dtype=np.int64), self.budget)
                numbers = chunk_numbers(end - first, self.budget, fill, chunk)
                edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    own, texts = line[lo:hi].tolist(), []
                    for k, a, e in zip(own, first[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
                        text, n = items[k]["line"], items[k]["n"]
                        texts.append(text if e - a == n else " ".join([w for w in _SPACE.split(text) if w][a:e]))
                    head = items[own[0]]
                    at.append(i)
                    rows.append((int(numbers[lo]), block, hi - lo, int((end - first)[lo:hi].sum()), head["page"],
                                 " ".join(f"#/lines/{items[k]['pos']}" for k in own), "\n".join(texts), head["type"]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), None, pa.string(), pa.string(), pa.string())
            names = ("chunk", "block", "n_lines", "n_tokens", "first_page", "ref", "text", "type")
            page = b.schema.field("items").type.value_type.field("page").type
            yield pa.RecordBatch.from_arrays(
                [b.column(self.doc).take(pa.array(at, pa.int64())),
                 *(pa.array([r[i] for r in rows], kind or page) for i, kind in enumerate(kinds))], names=[self.doc, *names])


def _starts(blocks: DataFrame, doc: str, budget: int) -> DataFrame | None:
    """(doc, block, fill, chunk): what is open before each block of the documents of several blocks; None if there are none."""
    order = Window.partitionBy(doc).orderBy("block")
    places = blocks.select(doc, "block", F.row_number().over(order).alias("place"), F.count("*").over(
        Window.partitionBy(doc)).alias("_n")).where("_n > 1").drop("_n")
    longest = places.agg(F.max("place")).first()[0]
    if longest is None:
        return None
    kind = blocks.schema[doc].dataType.simpleString()
    reach = blocks.select(doc, "block", "sizes").join(places, [doc, "block"]).select(doc, "place", "sizes").mapInArrow(
        _Transitions(doc, budget), f"`{doc}` {kind}, place int, fills array<bigint>, closed array<bigint>")
    step = 1
    while True:  # a table covers the `step` blocks that end with its own
        path = scratch_path(blocks.sparkSession, "chunk-fills")
        reach.write.parquet(path)
        reach = blocks.sparkSession.read.parquet(path)
        if step >= longest:
            break
        prior = reach.select(doc, (F.col("place") + step).alias("place"), F.col("fills").alias("f0"), F.col("closed").alias("c0"))
        f, c = F.col("fills"), F.col("closed")
        at = lambda table, x: F.get(table, x.cast("int"))
        reach = reach.join(prior, [doc, "place"], "left").select(
            doc, "place", F.when(F.col("f0").isNull(), f).otherwise(F.transform("f0", lambda x: at(f, x))).alias("fills"),
            F.when(F.col("f0").isNull(), c).otherwise(F.zip_with("c0", "f0", lambda n, x: n + at(c, x))).alias("closed"))
        step *= 2
    before = reach.select(doc, (F.col("place") + 1).alias("place"), F.col("fills")[0].cast("int").alias("fill"),
                          F.col("closed")[0].alias("chunk"))
    return places.join(before, [doc, "place"]).select(doc, "block", "fill", "chunk")


def pack_lines(lines: DataFrame, n_tokens: Column, budget: int, doc: str, pos: str, line: str, page: str, kind: str,
               block: int) -> DataFrame:
    """doc, chunk, n_lines, n_tokens, first_page, ref, text and type (of the first line) of each chunk."""
    ship_package(lines.sparkSession)
    item = F.struct(F.col(pos).alias("pos"), n_tokens.alias("n"), F.coalesce(F.col(line), F.lit("")).alias("line"),
                    F.col(page).alias("page"), F.col(kind).alias("type"))
    blocks = lines.select(doc, F.floor(F.col(pos) / block).alias("block"), item.alias("item")).groupBy(doc, "block").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    path = scratch_path(lines.sparkSession, "chunk-blocks")
    blocks.select(doc, "block", "items.n", "items").toDF(doc, "block", "sizes", "items").write.parquet(path)
    blocks = lines.sparkSession.read.parquet(path)
    starts = _starts(blocks, doc, budget)
    if starts is None:
        open_before = blocks.select(doc, "block", "items", F.lit(0).alias("fill"), F.lit(0).cast("long").alias("chunk"))
    else:
        open_before = blocks.join(starts, [doc, "block"], "left").select(
            doc, "block", "items", F.coalesce("fill", F.lit(0)).alias("fill"), F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"))
    kind_of = lambda c: c.dataType.simpleString()
    parts = open_before.mapInArrow(
        _Pack(doc, budget), f"`{doc}` {kind_of(blocks.schema[doc])}, chunk long, block long, n_lines long, n_tokens long, "
                            f"first_page {kind_of(lines.schema[page])}, ref string, text string, type string")
    own = F.sort_array(F.collect_list(F.struct("block", "first_page", "ref", "text", "type")))
    g = parts.groupBy(doc, "chunk").agg(own.alias("p"), F.sum("n_lines").alias("n_lines"), F.sum("n_tokens").alias("n_tokens"))
    return g.select(doc, F.col("chunk").cast("int").alias("chunk"), F.col("n_lines").cast("int").alias("n_lines"), "n_tokens",
                    F.col("p")[0]["first_page"].alias("first_page"), F.array_join("p.ref", " ").alias("ref"),
                    F.array_join("p.text", "\n").alias("text"), F.col("p")[0]["type"].alias("type"))
