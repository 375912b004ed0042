"""Stand-in inputs built from the driver's test tables.

Each view only reshapes a test table into the record shape a job expects
(evaluation rows, vector points, question sheets, raw responses, run-file
names, document lines).  None of them does any of the jobs' work; the jobs
must be right on any data of the same schema.  The expressions are the
fixture definitions fixed in FIXTURES.md, so the DuckDB oracle builds the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed dimension values of the evaluation fixtures.
MODELS = ["gen_a", "gen_b", "gen_c"]
RETRIEVERS = ["ret_a", "ret_b", "ret_c"]
DIFFICULTIES = ["Easy", "Medium", "Hard"]
PRICES = {"gen_a": 10.0, "gen_b": 2.0, "gen_c": 0.4}


def fx_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows (Model, Model_ret, Question_nr, Difficulty, Iteration, ...)."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    ev = ev.withColumn("k", F.regexp_extract("props", r"([0-9]+)", 1).cast("int"))
    return ev.selectExpr(
        "event_id",
        "CASE event_id % 3 WHEN 0 THEN 'gen_a' WHEN 1 THEN 'gen_b' ELSE 'gen_c' END AS Model",
        "CASE event_type WHEN 'click' THEN 'ret_a' WHEN 'view' THEN 'ret_b' "
        "WHEN 'purchase' THEN 'ret_c' ELSE event_type END AS Model_ret",
        "user_id AS Question_nr",
        "CASE WHEN user_id % 50 = 49 THEN NULL WHEN user_id % 3 = 0 THEN 'Easy' "
        "WHEN user_id % 3 = 1 THEN 'Medium' ELSE 'Hard' END AS Difficulty",
        "CAST(event_id % 5 + 1 AS INT) AS Iteration",
        "CASE WHEN user_id % 10 = 0 THEN 'General' "
        "ELSE concat('Paper', CAST(user_id % 25 + 1 AS STRING)) END AS Paper_id",
        "CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 101 = 0 THEN '[broken' "
        "ELSE concat('[''paper', CAST((user_id + k) % 25 + 1 AS STRING), '_pg_', CAST(k AS STRING), "
        "''', ''Paper', CAST(user_id % 25 + 1 + k % 2 AS STRING), '_pg_1'', ''Paper', "
        "CAST(k % 25 + 1 AS STRING), '_pg_2'', ''other_pg_3'', ''Paper1_pg_4'']') END AS Context_papers",
        "substr('ABCD', CAST(k % 4 + 1 AS INT), 1) AS Answer",
        "substr('ABCD', CAST(user_id % 4 + 1 AS INT), 1) AS Correct",
        "CASE WHEN k % 4 = user_id % 4 THEN 1 ELSE 0 END AS Cor_answer",
        "value AS Elapsed",
        "CAST(k * 100 + user_id AS BIGINT) AS Total_tokens",
    )


def fx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense points with a flat payload."""
    return read_table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "embedding", "label",
        "concat('Paper', CAST(vec_id % 25 + 1 AS STRING), '.pdf') AS document_name",
        "concat('https://doi.example/', CAST(vec_id % 25 + 1 AS STRING)) AS document_link",
        "CAST(floor(vec_id / 25) + 1 AS INT) AS page_no",
        "CASE vec_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'image' "
        "ELSE 'pdf_page' END AS type",
        "concat('user', CAST(label AS STRING)) AS username",
        "CASE WHEN vec_id % 4 >= 2 THEN concat('/vd/images/p', CAST(vec_id AS STRING), '.png') "
        "ELSE '' END AS img_link",
    )


def fx_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page patches for late interaction (page_key, patch_no, embedding): every embedding is a patch."""
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").selectExpr(
        "CAST(floor(vec_id / 10) AS BIGINT) AS page_key", "vec_id % 10 AS patch_no", "embedding")


def fx_qtokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query token vectors (query_id, token_no, embedding): four for every question, the embeddings dealt in turn."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = e.count()
    q = read_table(spark, sf_dir, "benchmark", "item_id").select(
        F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("token_no"))
    return q.join(e, e["vec_id"] == (q["query_id"] * 4 + q["token_no"]) % n).select(
        "query_id", F.col("token_no").cast("long").alias("token_no"), "embedding")


def fx_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question sheet (Question_nr, question, A-D, Correct, Difficulty)."""
    return read_table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS Question_nr", "text AS question",
        "concat('opt', CAST(item_id * 4 + 1 AS STRING)) AS A",
        "concat('opt', CAST(item_id * 4 + 2 AS STRING)) AS B",
        "concat('opt', CAST(item_id * 4 + 3 AS STRING)) AS C",
        "concat('opt', CAST(item_id * 4 + 4 AS STRING)) AS D",
        "substr('ABCD', CAST(item_id % 4 + 1 AS INT), 1) AS Correct",
        "CASE item_id % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' ELSE 'Hard' END AS Difficulty",
    )


def fx_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model responses (conv_id, turn, Question_nr, raw_response), dealt over all questions."""
    n = read_table(spark, sf_dir, "benchmark", "item_id").count()
    return (read_table(spark, sf_dir, "conversations")
            .where("role = 'assistant'")
            .selectExpr(
                "conv_id", "turn", f"conv_id % {n} AS Question_nr",
                "CASE conv_id % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B.' WHEN 2 THEN 'Answer: C.' "
                "WHEN 3 THEN concat('{\"answer\":\"', substr('ABCD', CAST(turn % 4 + 1 AS INT), 1), '\"}') "
                "WHEN 4 THEN NULL WHEN 5 THEN 'b' WHEN 6 THEN 'The answer is D' "
                "WHEN 7 THEN substr('ABCD', CAST(turn % 4 + 1 AS INT), 1) ELSE text END AS raw_response"))


def fx_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-file names (file_id, file_name)."""
    return read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").selectExpr(
        "o_orderkey AS file_id",
        "concat('eval_', CASE o_custkey % 3 WHEN 0 THEN 'gen-a' WHEN 1 THEN 'gen-b' ELSE 'gen-c' END, '_', "
        "CASE o_orderkey % 4 WHEN 0 THEN 'no_RAG' WHEN 1 THEN 'text_RAG' WHEN 2 THEN 'mm_RAG' ELSE 'colpali' END, '_', "
        "CASE o_orderstatus WHEN 'F' THEN 'perm' ELSE 'no_perm' END, '_benchmark_20250101-', "
        "substr(CAST(100000 + o_orderkey % 86400 AS STRING), 1, 6), "
        "CASE o_orderstatus WHEN 'F' THEN '_perm_q' ELSE '' END, "
        "CASE WHEN o_orderkey % 50 = 0 THEN '.bak' ELSE '.json' END) AS file_name")


def fx_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as typed elements (doc_id, pos, line, type)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return (lines.where(F.trim("line") != "")
            .withColumn("type", F.when(F.col("line").like("%|%"), "table").otherwise("text")))
