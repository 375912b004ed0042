"""Incremental loads with Structured Streaming.

* :func:`stream_upsert` - new point files arrive in a folder; each
  micro-batch is written into the collection, the last write per id, kept in
  buckets with versions (:mod:`.versions`): a batch rewrites the buckets it
  touches, a replayed batch is left out, and what no reader needs is removed.
* :func:`stream_run_accuracy` - run files arrive in a folder; a streaming
  aggregation keeps mean correctness per (model, retriever) in the state
  store and each micro-batch writes the (small) result table as a version of
  its own, so a reader never finds it missing.

Both run with ``trigger(availableNow=True)``: process what is there, stop.
Checkpoints live in the shared work folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions as VE


def stream_upsert(spark: SparkSession, source: str, schema: T.StructType, root: str, id_col: str,
                  version_col: str, max_files_per_trigger: int = 1, buckets: int = VE.BUCKETS) -> DataFrame:
    """Run the incremental load to completion and return the collection."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source))

    def merge(batch: DataFrame, batch_id: int) -> None:
        VE.upsert(batch.sparkSession, root, batch, id_col, version_col, buckets, batch_id)

    q = (src.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    VE.remove_old(spark, root)
    return collection_state(spark, root, id_col, version_col, [f.name for f in schema.fields])


def _newest_state(spark: SparkSession, root: str) -> int | None:
    """The last batch that is in the collection."""
    _, entries = VE.newest(spark, root)
    return entries[0].batch if entries else None


def collection_state(spark: SparkSession, root: str, id_col: str, version_col: str, cols: list[str]) -> DataFrame:
    """Last write per id: highest version, later batch on ties."""
    return VE.read(spark, root, id_col, cols)


def stream_run_accuracy(spark: SparkSession, source: str, schema: T.StructType, root: str,
                        keys=("Model", "Model_ret"), max_files_per_trigger: int = 1) -> DataFrame:
    """Run the streaming aggregation to completion and return its result table."""
    out = f"{root}/accuracy"
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source))
    agg = src.groupBy(*keys).agg(F.avg("Cor_answer").alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_v={batch_id}")

    q = (agg.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    found = VE.complete(spark, out)
    for old in found[:-VE.KEEP]:
        VE.remove(spark, f"{out}/_v={old}")
    return spark.read.parquet(f"{out}/_v={found[-1]}")
