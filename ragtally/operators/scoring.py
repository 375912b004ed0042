"""Scoring jobs: parse responses, undo permutations, join the answer key,
number iterations, union and order run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from .ordering import sequence_by_sort


def request_orders(requests: DataFrame, question_col: str = "Question_nr", run_col: str | None = None, seed: int = 42,
                   permuted=True, order_col: str = "quest_order") -> DataFrame:
    """Requests with the option order to store with each of them, drawn anew for each run."""
    return requests.withColumn(order_col, A.permutation(question_col, seed, permuted, run_col))


def score_responses(responses: DataFrame, response_col: str = "raw_response",
                    order_col: str = "quest_order") -> DataFrame:
    """Add filt_resp (shown letter) and answer (original letter, by the option order stored with the request)."""
    return (responses.withColumn("filt_resp", A.parse_answer(response_col))
            .withColumn("answer", A.unpermute_answer("filt_resp", order_col)))


def join_answer_key(runs: DataFrame, key: DataFrame, answer_col: str = "answer",
                    key_cols: Sequence[str] = ("Correct", "Difficulty")) -> DataFrame:
    """Left join runs to the answer key on Question_nr; Cor_answer = 1 when the
    answer equals the key, else 0 (also when unmatched or null).

    The key has one row per question.  Whether it is broadcast is left to the
    session's byte threshold (static or adaptive statistics).
    """
    k = key.select("Question_nr", *key_cols)
    out = runs.join(k, "Question_nr", "left")
    return out.withColumn(
        "Cor_answer", F.coalesce((F.col(answer_col) == F.col("Correct")).cast("int"), F.lit(0)))


def parse_run_files(files: DataFrame, name_col: str = "file_name", ext: str = ".json") -> DataFrame:
    """Run-file names -> parsed metadata columns; keeps only names with the
    run extension.  Rows with valid = false are names that do not follow the
    layout (send them to a reject table)."""
    return A.with_run_name(files.where(F.col(name_col).endswith(ext)), name_col)


def reject_run_files(files: DataFrame, name_col: str = "file_name", ext: str = ".json") -> DataFrame:
    """Run files whose names do not parse."""
    return parse_run_files(files, name_col, ext).where(~F.col("valid")).select(*files.columns)


def iteration_number(files: DataFrame, pair_cols: Sequence[str], path_col: str = "file_name",
                     out_col: str = "Iteration") -> DataFrame:
    """Number the run files of each pair 1, 2, ... in path order.

    Works on the distinct file list (one row per file, not per evaluation
    row).  Numbering is skew-safe (range sort + per-partition offsets), so a
    pair holding most files is still spread over many tasks.
    """
    distinct = files.select(*pair_cols, path_col).distinct()
    return sequence_by_sort(distinct, pair_cols, [path_col], out_col)


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Union run tables by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sort_full_report(df: DataFrame, model_col: str, category_col: str, categories: Sequence[str],
                     flag_col: str, question_col: str = "Question_nr") -> DataFrame:
    """Order rows by model, category list position (off-list last), flag and
    question.  A distributed range sort, not a single-task sort."""
    pos = F.create_map(*[x for i, v in enumerate(categories) for x in (F.lit(v), F.lit(i))])
    ordinal = F.element_at(pos, F.col(category_col))
    return (df.withColumn("category_ordinal", ordinal)
            .orderBy(F.col(model_col).asc_nulls_last(), F.col("category_ordinal").asc_nulls_last(),
                     F.col(flag_col).asc_nulls_last(), F.col(question_col).asc_nulls_last()))
