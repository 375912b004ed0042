"""Skew-safe running sums and per-key numbering.

A window ``partitionBy(key).orderBy(...)`` puts every row of a key in one
task; with a key holding a third of all rows that task holds a third of the
data.  The helpers here split keys into blocks and add block offsets:

* :func:`running_sum` - numeric positions: blocks of ``block`` positions.
* :func:`sequence_by_sort` - any order: a distributed range sort (its
  partitions split a hot key), numbers inside each (sort partition, key),
  and offsets from the count table of earlier sort partitions, which has at
  most (partitions x keys) rows.  The sorted rows are checkpointed with their
  partition's number before the two branches read them: sorted twice, the
  partitions would not have the same bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import col
from ..session import work_dir

BLOCK = 4096

def _join_null_safe(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on `cols` where null equals null; keeps one copy of each column."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols],
                     *[c for c in right.columns if c not in cols])
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond).drop(*[f"_r_{c}" for c in cols])


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value, out: str, block: int = BLOCK,
                exclusive: bool = False) -> DataFrame:
    """Running sum of `value` in `pos` order within `keys` (pos numeric and
    unique within a key): block totals -> prefix over blocks -> window inside
    a block."""
    keys = list(keys)
    d = df.withColumn("_v", col(value)).withColumn("_blk", F.floor(F.col(pos) / block))
    tot = d.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_bt"))
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wb), F.lit(0))).drop("_bt")
    wi = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("_v").over(wi))
    res = _join_null_safe(d, off, keys + ["_blk"]).withColumn(out, F.col("_off") + F.col("_in"))
    if exclusive:
        res = res.withColumn(out, F.col(out) - F.col("_v"))
    return res.drop("_v", "_blk", "_off", "_in")


def sequence_number(df: DataFrame, keys: Sequence[str], pos: str, out: str, block: int = BLOCK) -> DataFrame:
    """1, 2, ... in numeric `pos` order within `keys`."""
    return running_sum(df, keys, pos, F.lit(1), out, block).withColumn(out, F.col(out).cast("int"))


def running_sum_by_sort(df: DataFrame, keys: Sequence[str], order: Sequence[str], value, out: str) -> DataFrame:
    """Inclusive running sum of `value` in `order` within `keys`, for any
    sortable order (give a unique order): range sort, sums inside each
    (sort partition, key), offsets from earlier sort partitions' totals.

    The sorted input is written once, with its partition numbers, as a
    reliable checkpoint below the shared folder; both branches read that."""
    keys, order = list(keys), list(order)
    s = (df.withColumn("_v", col(value))
         .repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_sp", F.spark_partition_id()))
    work_dir(s.sparkSession)  # sets the checkpoint folder when a local session has none
    s = s.checkpoint(eager=True)
    wi = Window.partitionBy("_sp", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = s.groupBy(*keys, "_sp").agg(F.sum("_v").alias("_n"))
    wo = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_sp") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    res = _join_null_safe(s.withColumn("_in", F.sum("_v").over(wi)), offs, keys + ["_sp"])
    return res.withColumn(out, F.col("_off") + F.col("_in")).drop("_sp", "_in", "_off", "_v")


def sequence_by_sort(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1, 2, ... in `order` within `keys` for any sortable order columns
    (ties broken by the remaining columns of `order`; give a unique order).
    Without keys, the offsets window runs over one row per sort partition."""
    res = running_sum_by_sort(df, keys, order, F.lit(1), out)
    return res.withColumn(out, F.col(out).cast("int"))
