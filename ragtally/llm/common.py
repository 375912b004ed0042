"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, work_dir

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a bitmap of keys
MOST_SLOTS = 1 << 25


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table (whole), as Spark splits it."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) from a hash of the columns: rows below s are a share s of all, the same in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / float(1 << 31)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows below the shared folder and read them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's key columns go."""
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"__{k}"])
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def slots(keys: int) -> int:
    """Bits for so many keys: 16 to a key, at most MOST_SLOTS."""
    return min(MOST_SLOTS, max(1 << 12, 1 << (16 * keys).bit_length()))


def likely(rows: DataFrame, wanted: DataFrame, slots: int, key: str = "row_key") -> DataFrame:
    """The rows whose key is among those of `wanted`, and a few others: a key sets one of `slots` bits, and the
    bits go to every task as one row.  So the other rows are not shuffled for a join on the key."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    word = lambda at: F.floor(at / 64).cast("int")
    some = wanted.select(slot.alias("slot")).groupBy(word(F.col("slot")).alias("word")).agg(F.bit_or(bit(F.col("slot"))).alias("bits"))
    every = rows.sparkSession.range(slots // 64).select(F.col("id").cast("int").alias("word"))
    every = every.join(some, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    table = every.agg(F.sort_array(F.collect_list("w")).getField("bits").alias("__bits"))
    return rows.join(F.broadcast(table), F.get(F.col("__bits"), word(slot)).bitwiseAND(bit(slot)) != 0, "left_semi")


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """0, 1, 2, ... in the given order over all rows, without one task for all of them: range sort, numbers
    within each part, and the sizes of the parts before.  The sorted rows are written once with their part's
    number, so both readers see the same parts."""
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = written(parts, "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").count().select(
        "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (parts.withColumn("__in", inside).join(starts, "__part")
            .withColumn(out, F.col("__start") + F.col("__in") - 1).drop("__part", "__in", "__start"))


def smallest_reachable(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node
    reachable.  Alternating large-star and small-star steps; each round is written to the shared folder, and
    a round ends the loop when no edge changed (compared by count and a sum of hashes).  A node without edges
    does not appear."""
    spark = edges.sparkSession
    work_dir(spark)

    def sides(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                        .alias("e")).select("e.a", "e.b")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = sides(e)
        near = both if large else both.where("b <= a")
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        linked = near.join(least, "a")
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        return tuple(row)

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a <> b").distinct(), "edges")
    seen = mark(now)
    for _ in range(most_rounds):
        now = written(star(star(now, True), False), "edges")
        if (found := mark(now)) == seen:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = found
    raise RuntimeError("components did not settle")
