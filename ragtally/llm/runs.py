"""Periodic run detection (operator 12): repetitions within a text, and the text without them.

A run is a maximal stretch of words with a smallest period q, periods.LEAST_LENGTH words or more and at least
periods.EXPONENT * q long.  :mod:`ragtally.llm.periods` finds them by a suffix automaton with link-cut access.  Texts
are independent: the work is one narrow pass over Arrow batches, without a shuffle, and holds one text's automaton at
a time.

Defined results: null, empty and blank texts have no words and no runs; very long texts are processed whole, in time
O(n log n) for n words; ties of the longest run go to the smallest start, then period; repeated rows give repeated
rows; a null doc_id stays null; an empty table gives an empty result; columns other than doc_id and text are not
looked at by :func:`periodic` and kept by :func:`without_runs`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import periods
from .common import let, text_of, words

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _batches(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found, kept = [], [], []
            for text in b.column("__text").cast(pa.binary()).to_pylist():
                parts = text.split()  # bytes: only ASCII white space separates
                of = periods.runs(parts)
                counts.append(len(parts))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in of])
                kept.append(b" ".join(periods.collapsed(parts, of)))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in columns] + [pa.array(counts, pa.int64()), pa.array(found, _RUNS),
                                                  pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*columns, "n_words", "runs", "collapsed"])
    return run


def periodic(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the kept words, one space apart) per row."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("__text")).mapInArrow(
        _batches(["doc_id"]), f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string")


def without_runs(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns; a text that has runs keeps its words outside them and the runs' first periods."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), text_of().alias("__text"))
    schema = f"__doc {rows.schema['__doc'].dataType.simpleString()}, n_words long, runs array<{_RUN}>, collapsed string"
    out = rows.mapInArrow(_batches(["__doc"]), schema)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("__doc.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("__doc").getField(c).alias(c) for c in docs.columns])


def longest(runs: Column) -> Column:
    """The run of greatest exact length / period, the first of equals; null if there is none."""
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id and text, where h = crc32(doc_id) is divisible by 10 made periodic: with g = floor(h / 10), a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)), word i of n becomes word a + (i - a) % p from word a on.  A null doc_id has no
    h and stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n.cast("long") - 1), lambda i: F.element_at(w, (a + (i - a) % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(text_of()), repeated)).otherwise(text_of()).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, its exponent in thousandths, and digests of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = found.withColumn("__top", longest(F.col("runs")))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__top.start").alias("start"),
        F.col("__top.length").alias("length"), F.col("__top.period").alias("period"),
        F.floor(F.col("__top.length") * 1000 / F.col("__top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
