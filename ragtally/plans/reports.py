"""End-to-end report plans composed from the operators.

* :func:`exp1_report` - parsed answers joined to the key, retrieval modes in
  category order, accuracy by difficulty, majority votes, the full sorted
  table; one sheet each.
* :func:`ci_report` - per-iteration metrics, CI summary with and without
  difficulty, the difficulty-wide table and metric descriptions.
* :func:`sd_report` - mean (SD) tables by difficulty and overall, joined.

Each returns a dict of sheet name -> DataFrame; pass it to
:func:`ragtally.sources.sinks.write_report` to write one table per sheet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import scoring as SC
from ..operators import summaries as SUM
from . import run_plan as RP

EXP1_MODES = ("no_RAG", "text_RAG", "mm_RAG", "colpali")
DIFFICULTIES = ("Easy", "Medium", "Hard")


def exp1_report(answers: DataFrame, key: DataFrame, run_keys: Sequence[str] = ("model_short", "vd_name",
                                                                               "perm_label"),
                modes: Sequence[str] = EXP1_MODES) -> dict[str, DataFrame]:
    """answers: one row per (run, question) with `answer` (original letter) and
    the run columns; key: question sheet (Question_nr, Correct, Difficulty)."""
    scored = SC.join_answer_key(answers, key)
    in_modes = SUM.filter_categories(scored, run_keys[1], modes)
    return {
        "Accuracy": SUM.accuracy_pivot(in_modes, list(run_keys), "Difficulty", DIFFICULTIES),
        "Majority": SUM.majority_vote(in_modes, list(run_keys), ["Question_nr", "Difficulty"]),
        "Full": SC.sort_full_report(scored, run_keys[0], run_keys[1], modes, run_keys[2]),
    }


def ci_report(spark: SparkSession, evals: DataFrame, prices: Mapping[str, float], k: int,
              models: Sequence[str], retrievers: Sequence[str]) -> dict[str, DataFrame]:
    """The confidence-interval workbook of experiment 2 as sheets."""
    keys = ["Model", "Model_ret", "Difficulty"]
    summary = SUM.ci_summary(evals, keys, prices, k, models, retrievers)
    metrics = [m for m, _s, _k, _d in SUM.CI_METRICS]
    desc = spark.createDataFrame(RP.metric_descriptions(k), "Metric string, Description string")
    return {
        f"diff_topk{k}": SUM.ci_summary_wide(summary, ["Model", "Model_ret"], "Difficulty", DIFFICULTIES, metrics),
        f"overview_topk{k}": SUM.ci_summary(evals, ["Model", "Model_ret"], prices, k, models, retrievers),
        "per_iteration": SUM.per_iteration(evals, keys, prices, k, models, retrievers),
        "Descriptions": desc,
    }


def sd_report(evals: DataFrame, models: Sequence[str], retrievers: Sequence[str]) -> dict[str, DataFrame]:
    """Mean (SD) of correctness and context hit, by difficulty (wide) and
    overall, joined on (Model, Model_ret)."""
    ev = SUM.filter_categories(SUM.filter_categories(evals, "Model", models), "Model_ret", retrievers)
    ev = ev.withColumn("hit", M.hit_at_k("Paper_id", "Context_papers"))
    by_diff = SUM.sd_summary(SUM.filter_categories(ev, "Difficulty", DIFFICULTIES),
                             ["Model", "Model_ret", "Difficulty"])
    wide = SUM.ci_summary_wide(by_diff, ["Model", "Model_ret"], "Difficulty", DIFFICULTIES, ["Cor_answer", "hit"])
    overall = SUM.sd_summary(ev, ["Model", "Model_ret"]).select(
        "Model", "Model_ret", F.col("Cor_answer").alias("Cor_answer_summary"), F.col("hit").alias("hit_summary"))
    return {"Summary": wide.join(overall, ["Model", "Model_ret"]), "raw_evaluations": ev}
