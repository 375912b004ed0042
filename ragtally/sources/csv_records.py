"""Quoted CSV with line breaks inside fields, read in splits.

Spark's multi-line CSV reader takes a file as one task.  Here files are read as
lines, in splits, and lines become records by the quote signs before them: a
line starts a record if their number in its file is even.

1. Quote signs per split, and their running sum over the splits of a file (a
   row a split: no text moves).
2. Lines with the quote signs before them in their split: a narrow pass that
   keeps two counters.
3. A line that starts and ends a record is one.  Only the others are numbered
   (skew-safe, :mod:`..operators.ordering`) and joined to records.

The text is scanned three times and only records of several lines are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import running_sum_by_sort
from ..session import ship_package


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of each line in its split, and the quote signs before it there.  Lines come in the order of their split."""
    key, line, before = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        quotes, block = b.column("quotes").to_numpy(), b.column("block").to_numpy()
        file = b.column("file_path").dictionary_encode()
        code = file.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])])
        lines, prior = np.empty(len(quotes), np.int64), np.empty(len(quotes), np.int64)
        for lo, hi in zip(starts, [*starts[1:], len(quotes)], strict=True):
            this = (file.dictionary[code[lo]].as_py(), int(block[lo]))
            if this != key:
                key, line, before = this, 0, 0
            upto = before + np.cumsum(quotes[lo:hi])
            lines[lo:hi], prior[lo:hi] = np.arange(line, line + hi - lo), upto - quotes[lo:hi]
            line, before = line + int(hi - lo), int(upto[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines), pa.array(prior)],
                                         names=[*b.schema.names, "line", "before"])


def csv_records(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Records of the CSV files at `path` -> (file_path, block, line, record): the text of each record, and where it
    starts (split and line in the split, in file order).  Empty lines between records are left out.

    Quote signs stand in quoted fields only, doubled inside (RFC 4180).  A quote that is never closed takes the rest
    of its file as one record; a record has to fit into a task, as in any CSV reader."""
    ship_package(spark)
    lines = (spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
                     "value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("quotes")))
    split = ["file_path", "block"]
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy(*split).agg(F.sum("quotes").alias("n")).select(
        *split, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    counted = lines.mapInArrow(_count, "file_path string, block long, value string, quotes long, line long, before long")
    at = F.col("offset") + F.col("before")
    marked = counted.join(offsets, split).select(
        *split, "line", "value", (at % 2 == 0).alias("starts"), ((at + F.col("quotes")) % 2 == 0).alias("ends"))
    alone = F.col("starts") & F.col("ends")
    whole = marked.where(alone).select(*split, "line", F.col("value").alias("record"))
    parts = running_sum_by_sort(marked.where(~alone), ["file_path"], ["block", "line"], F.col("starts").cast("long"), "no")
    joined = parts.groupBy("file_path", "no").agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("p")).select(
        "file_path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"),
        F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("record"))
    # a line break of two signs leaves its first one at the record's end
    return whole.union(joined).withColumn("record", F.rtrim("record", F.lit("\r"))).where(F.col("record") != "")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str], recursive: bool = False) -> DataFrame:
    """Rows of the CSV files at `path`, each file with a header line -> (columns of `schema`, file_path, block, line).
    Columns go by position; fields that can't be read as their type are null, as in Spark's permissive mode."""
    kept = {k: v for k, v in options.items() if k != "header"}
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = csv_records(spark, path, recursive).where((F.col("block") > 0) | (F.col("line") > 0))
    return rows.withColumn("_row", F.from_csv("record", kind, kept)).select(
        *[F.col("_row").getField(f.name).alias(f.name) for f in schema.fields], "file_path", "block", "line")
