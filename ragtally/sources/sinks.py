"""Sinks: run tables, report sheets, request exports, response imports and
the embedding cache.  All writes go below the shared work folder (see
:func:`ragtally.session.work_dir`) and are idempotent per output path, so a
re-run after a lost executor rewrites the same files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table_exists
from ..streaming.versions import complete_folders
from .readers import CSV_OPTIONS


def write_run(df: DataFrame, path: str, partition_cols=("Model", "Model_ret", "Iteration"),
              mode: str = "append") -> None:
    """One output folder per (model, retriever, iteration), parquet."""
    df.write.mode(mode).partitionBy(*partition_cols).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(sheets: Mapping[str, DataFrame], path: str, csv: bool = True) -> dict[str, str]:
    """One table folder per sheet (parquet, and CSV for spreadsheet users)."""
    out = {}
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        if csv:
            df.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path}/{name}_csv")
        out[name] = f"{path}/{name}"
    return out


def export_requests(requests: DataFrame, path: str, id_col: str, model: str,
                    message_col: str = "message") -> None:
    """Batch-inference input as JSON lines: {custom_id, body: {model, messages}}."""
    body = F.struct(F.lit(model).alias("model"),
                    F.array(F.struct(F.lit("user").alias("role"), F.col(message_col).alias("content")))
                    .alias("messages"))
    line = F.to_json(F.struct(F.col(id_col).cast("string").alias("custom_id"), body.alias("body")))
    requests.select(line.alias("value")).write.mode("overwrite").text(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    schema = ("custom_id string, body struct<model:string, messages:array<struct<role:string, "
              "content:array<struct<type:string,text:string,url:string>>>>>")
    return spark.read.schema(schema).json(path)


RESPONSE_SCHEMA = T.StructType([T.StructField("custom_id", T.StringType()),
                                T.StructField("content", T.StringType())])


def import_responses(spark: SparkSession, requests: DataFrame, responses_path: str, id_col: str = "custom_id",
                     error_pattern: str = r"^\[error\]") -> DataFrame:
    """Requests joined to their responses -> (custom_id, content, status).

    status: 'ok' (a usable response), 'failed' (only null or error responses;
    send again) or 'missing' (no response line)."""
    resp = spark.read.schema(RESPONSE_SCHEMA).json(responses_path)
    good = F.col("content").isNotNull() & ~F.coalesce(F.col("content").rlike(error_pattern), F.lit(False))
    per_id = resp.groupBy("custom_id").agg(
        F.count(F.lit(1)).alias("n_responses"),
        # a usable response first; among several, the greatest text (deterministic)
        F.max_by(F.col("content"), F.struct(F.when(good, 1).otherwise(0), F.col("content"))).alias("content"),
        F.max(good.cast("int")).alias("_ok"))
    j = requests.select(F.col(id_col).alias("custom_id")).join(per_id, "custom_id", "left")
    status = (F.when(F.col("n_responses").isNull(), "missing")
              .when(F.col("_ok") == 1, "ok").otherwise("failed"))
    return j.select("custom_id", F.coalesce("n_responses", F.lit(0)).alias("n_responses"),
                    F.when(F.col("_ok") == 1, F.col("content")).alias("content"), status.alias("status"))


def export_again(spark: SparkSession, requests: DataFrame, responses_path: str, path: str, id_col: str, model: str,
                 message_col: str = "message") -> None:
    """Batch-inference input of the requests without a usable response among all responses at `responses_path` (a
    folder that keeps the responses of each send), as :func:`export_requests` writes it.  Only ids take part in the
    decision; a request whose responses all failed is sent once more, whatever their number."""
    ids = requests.select(F.col(id_col).cast("string").alias("custom_id"))
    done = import_responses(spark, ids, responses_path).where(F.col("status") == "ok").select(F.col("custom_id").alias("_done"))
    left = requests.join(done, F.col(id_col).cast("string") == F.col("_done"), "left_anti")
    export_requests(left, path, id_col, model, message_col)


def embedding_cache(spark: SparkSession, root: str, vectoriser: str,
                    compute: Callable[[], DataFrame]) -> DataFrame:
    """Read `{root}/{vectoriser}` when a complete table is there; otherwise
    run `compute`, write it, and read the written table back."""
    path = f"{root.rstrip('/')}/{vectoriser.replace('/', '__')}"
    if not table_exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(content: str) -> Column:
    """SHA-256 of a column's value, of any type; null has a key of its own (its field is left out)."""
    return F.sha2(F.to_json(F.struct(F.col(content).alias("c"))), 256)


def fill_cache(spark: SparkSession, root: str, vectoriser: str, rows: DataFrame, content: str,
               compute: Callable[[DataFrame], DataFrame]) -> int:
    """Compute what the cache of a vectoriser lacks, and nothing else; returns how many contents that were.

    The cache `{root}/{vectoriser}` is keyed by content: rows of equal content share an entry, a row that moves
    or repeats costs nothing, a changed row is computed anew.  `compute` gets the missing (key, `content`), each
    once, and returns them with a key column and whatever it makes of them.  A fill writes a folder of its own; one
    that was cut off has no _SUCCESS and is not read."""
    path = f"{root.rstrip('/')}/{vectoriser.replace('/', '__')}"
    wanted = rows.select(content_key(content).alias("key"), content)
    if (known := _cached(spark, path)) is not None:
        wanted = wanted.join(known.select("key"), "key", "left_anti")
    # equal contents are combined before the shuffle; a hot one leaves one row a task
    missing = wanted.groupBy("key").agg(F.any_value(content).alias(content))
    fill = f"{path}/_fill={uuid.uuid4().hex}"
    compute(missing).write.parquet(fill)
    return spark.read.parquet(fill).count()


def cached_vectors(spark: SparkSession, root: str, vectoriser: str, rows: DataFrame, content: str) -> DataFrame:
    """The rows with what the cache holds for their content (null where it holds nothing)."""
    path = f"{root.rstrip('/')}/{vectoriser.replace('/', '__')}"
    known = _cached(spark, path)
    if known is None:
        raise ValueError(f"no complete fill at {path}")
    # two fills at once may both have computed a content
    known = known.dropDuplicates(["key"])
    return rows.withColumn("key", content_key(content)).join(known, "key", "left").drop("key")


def _cached(spark: SparkSession, path: str) -> DataFrame | None:
    """The complete fills of a cache."""
    fills = [f"{path}/{name}" for name in complete_folders(spark, path, "_fill=")]
    return spark.read.parquet(*fills) if fills else None
