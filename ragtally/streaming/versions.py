"""Collections that change, as bucket tables with versions.

A collection lies below `root` in a fixed number of buckets of the id's hash:

* ``state/_v=<n>/_bucket=<b>`` - the rows of bucket b as version n wrote them;
* ``deleted/_v=<n>`` - the ids that version n deleted;
* ``manifest/_v=<n>`` - version n itself: per bucket, the version that holds
  its rows and the deletions since, at most one row a bucket.

A version is there when its manifest is complete (written last), so a reader
sees all of a change or nothing, and a change that was cut off leaves no trace:
the next one takes the same number and overwrites it.  An upsert rewrites only
the buckets that its rows touch; a delete writes only the ids it deletes, which
go when their bucket is next rewritten.  Ids are unique in a bucket, so buckets
are even whatever the rows are.

Only manifests (a row a bucket) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_exists

BUCKETS = 64
#: Versions that readers may still use.
KEEP = 3


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers n of the complete tables `path`/_v=<n>, ascending."""
    return sorted(int(x.split("=")[1]) for x in complete_folders(spark, path, "_v="))


def complete_folders(spark: SparkSession, path: str, start: str) -> list[str]:
    """Names of the completely written tables in `path` that begin with `start`."""
    return [x for x in _names(spark, path) if x.startswith(start) and table_exists(spark, f"{path}/{x}")]


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    return [int(x.split("=")[1]) for x in _names(spark, path) if x.startswith(name + "=")]


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def manifest(spark: SparkSession, root: str, version: int) -> list:
    """Rows (bucket, version, deletes, buckets, batch) of a version, one a bucket that has rows."""
    return spark.read.parquet(f"{root}/manifest/_v={version}").collect()


def newest(spark: SparkSession, root: str) -> tuple[int, list]:
    """Number and manifest of the newest version; (-1, []) without one."""
    found = complete(spark, f"{root}/manifest")
    return (found[-1], manifest(spark, root, found[-1])) if found else (-1, [])


def _publish(spark: SparkSession, root: str, version: int, rows: list[tuple]) -> None:
    kind = "bucket int, version int, deletes array<int>, buckets int, batch long"
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/_v={version}")


def _rows(spark: SparkSession, root: str, id_col: str, entries: list) -> DataFrame:
    """The rows of the buckets of a manifest's entries, with _bucket."""
    state = spark.read.option("basePath", f"{root}/state").parquet(
        *[f"{root}/state/_v={e.version}/_bucket={e.bucket}" for e in entries])
    gone = sorted({d for e in entries for d in e.deletes})
    if gone:
        ids = spark.read.option("basePath", f"{root}/deleted").parquet(*[f"{root}/deleted/_v={d}" for d in gone])
        ids = ids.select(F.col(id_col).alias("_id"), F.col("_v").alias("_d"))
        # a later version of the bucket has taken the deletion in, or brought the id back
        state = state.join(ids, state[id_col].eqNullSafe(ids["_id"]) & (state["_v"] < ids["_d"]), "left_anti")
    return state.drop("_v")


def read(spark: SparkSession, root: str, id_col: str, columns: Sequence[str], version: int | None = None) -> DataFrame:
    """The collection as the given version (default: the newest) has it."""
    entries = newest(spark, root)[1] if version is None else manifest(spark, root, version)
    if not entries:
        raise ValueError(f"no version of a collection at {root}")
    return _rows(spark, root, id_col, entries).select(*columns)


def last_writes(rows: DataFrame, id_col: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per id, that of the greatest `order` (combined before the shuffle)."""
    rest = F.struct(*[F.col(c) for c in columns if c != id_col])
    best = rows.groupBy(id_col, "_bucket").agg(F.max_by(rest, F.struct(*order)).alias("_row"))
    return best.select(id_col, "_row.*", "_bucket").select(*columns, "_bucket")


def upsert(spark: SparkSession, root: str, rows: DataFrame, id_col: str, version_col: str,
           buckets: int = BUCKETS, batch: int | None = None) -> list[int]:
    """Write rows into the collection, the highest version_col per id wins and the newer write on ties.  Returns
    the buckets it rewrote.  `batch` numbers a stream's batches: one that is already in is left out.  `buckets`
    counts only for the first write; null ids are one id."""
    columns = rows.columns
    at, entries = newest(spark, root)
    if entries:
        buckets = entries[0].buckets
        if batch is not None and batch <= entries[0].batch:
            return []
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")
    incoming = f"{root}/incoming"
    last_writes(rows.withColumn("_bucket", bucket), id_col, [version_col], columns).write.mode("overwrite").parquet(incoming)
    new = spark.read.parquet(incoming)
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    before = [e for e in entries if e.bucket in set(touched)]
    both = new.withColumn("_new", F.lit(1))
    if before:
        both = both.unionByName(_rows(spark, root, id_col, before).withColumn("_new", F.lit(0)))
    merged = last_writes(both, id_col, [version_col, "_new"], columns)
    merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/state/_v={at + 1}")
    number = batch if batch is not None else (entries[0].batch if entries else -1)
    kept = [(e.bucket, e.version, e.deletes, buckets, number) for e in entries if e.bucket not in set(touched)]
    if touched or kept:
        _publish(spark, root, at + 1, kept + [(b, at + 1, [], buckets, number) for b in touched])
    remove(spark, incoming)
    return touched


def delete(spark: SparkSession, root: str, id_col: str, selector: Column | str) -> int:
    """Delete the rows that the selector holds for (null: stays); only their ids are written.  Returns how many."""
    at, entries = newest(spark, root)
    if not entries:
        return 0
    ids = _rows(spark, root, id_col, entries).where(selector).select(id_col, "_bucket")
    ids.write.mode("overwrite").parquet(f"{root}/deleted/_v={at + 1}")
    gone = {r["_bucket"]: r["count"] for r in spark.read.parquet(f"{root}/deleted/_v={at + 1}").groupBy("_bucket").count().collect()}
    if gone:
        _publish(spark, root, at + 1, [(e.bucket, e.version, e.deletes + ([at + 1] if e.bucket in gone else []),
                                       e.buckets, e.batch) for e in entries])
    return sum(gone.values())


def remove_old(spark: SparkSession, root: str, keep: int = KEEP) -> None:
    """Remove what none of the newest `keep` versions names."""
    found = complete(spark, f"{root}/manifest")
    live = [e for n in found[-keep:] for e in manifest(spark, root, n)]
    used, deletes = {(e.version, e.bucket) for e in live}, {d for e in live for d in e.deletes}
    for n in _numbers(spark, f"{root}/manifest", "_v"):
        if found and n < found[-keep:][0]:
            remove(spark, f"{root}/manifest/_v={n}")
    for n in _numbers(spark, f"{root}/state", "_v"):
        mine = _numbers(spark, f"{root}/state/_v={n}", "_bucket")
        if not any((n, b) in used for b in mine):
            remove(spark, f"{root}/state/_v={n}")
            continue
        for b in mine:
            if (n, b) not in used:
                remove(spark, f"{root}/state/_v={n}/_bucket={b}")
    for n in _numbers(spark, f"{root}/deleted", "_v"):
        if n not in deletes:
            remove(spark, f"{root}/deleted/_v={n}")
