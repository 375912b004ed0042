"""Paired rank tests between conditions (retrieval modes) per model.

Item accuracies are pivoted wide (one row per model and item, one column per
condition of the fixed list), so condition pairs come from that fixed list
(at most len(list) choose 2 per item) without a self join.  Then the
Wilcoxon signed-rank test with normal approximation, tie and continuity
corrections (paired, two-sided, not exact), and a Bonferroni adjustment.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .ordering import running_sum_by_sort


def item_accuracy(runs: DataFrame, model: str, condition: str, item: str, correct: str,
                  conditions: Sequence[str]) -> DataFrame:
    """Mean correctness per (model, item) with one column per condition."""
    return (runs.groupBy(model, item).pivot(condition, list(conditions))
            .agg(F.avg(F.col(correct).cast("double"))))


def item_pairs(wide: DataFrame, model: str, item: str, conditions: Sequence[str]) -> DataFrame:
    """(model, cond_1, cond_2, item, x, y) for every pair of the list in list
    order (cond_1 before cond_2), one row per item."""
    pairs = list(combinations(conditions, 2))
    arr = F.array(*[F.struct(F.lit(a).alias("cond_1"), F.lit(b).alias("cond_2"),
                             F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in pairs])
    return wide.select(model, item, F.explode(arr).alias("p")).select(
        model, "p.cond_1", "p.cond_2", item, "p.x", "p.y")


def wilcoxon_ranks(pairs: DataFrame, model: str, item: str) -> DataFrame:
    """Signed differences d = x - y of complete pairs, zeros removed, with the
    average rank of |d| within (model, pair)."""
    d = (pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
         .withColumn("d", F.col("x") - F.col("y")).where(F.col("d") != 0)
         .withColumn("abs_d", F.abs("d")))
    key = [model, "cond_1", "cond_2"]
    # average rank of a value = rows below it + (its tie count + 1) / 2, from a
    # running count over the distinct values (skew-safe, see ordering.py)
    ties = d.groupBy(*key, "abs_d").agg(F.count(F.lit(1)).alias("tie_size"))
    cum = running_sum_by_sort(ties, key, ["abs_d"], "tie_size", "_cum")
    ranks = cum.select(*key, "abs_d", "tie_size",
                       (F.col("_cum") - F.col("tie_size") + (F.col("tie_size") + 1) / 2.0).alias("rank"))
    return d.join(ranks, key + ["abs_d"])


def wilcoxon_test(pairs: DataFrame, model: str, item: str) -> DataFrame:
    """Per (model, pair): n_items_used (complete pairs, zeros included),
    statistic V (rank sum of positive d) and the two-sided p-value.

    Everything comes from one table of distinct |d| values per (model, pair)
    with their tie count t and number of positive d: average rank = values
    below + (t + 1) / 2, V = sum(rank x positives), n = sum(t), tie term =
    sum(t^3 - t)."""
    key = [model, "cond_1", "cond_2"]
    used = (pairs.groupBy(*key)
            .agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_items_used")))
    d = (pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
         .withColumn("d", F.col("x") - F.col("y")).where(F.col("d") != 0)
         .withColumn("abs_d", F.abs("d")))
    vals = d.groupBy(*key, "abs_d").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("pos"))
    vals = running_sum_by_sort(vals, key, ["abs_d"], "t", "_cum")
    rank = F.col("_cum") - F.col("t") + (F.col("t") + 1) / 2.0
    agg = vals.groupBy(*key).agg(F.sum("t").alias("n"), F.sum(rank * F.col("pos")).alias("V"),
                                 F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie_term"))
    j = used.join(agg, key, "left").select(
        *key, "n_items_used", F.coalesce(F.col("V"), F.lit(0.0)).alias("statistic"),
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("_n"),
        F.coalesce(F.col("tie_term"), F.lit(0.0)).cast("double").alias("_tt"))
    j = j.select("*", F.expr("statistic - _n * (_n + 1) / 4.0D").alias("_z0"),
                 F.expr("sqrt(_n * (_n + 1) * (2 * _n + 1) / 24.0D - _tt / 48.0D)").alias("_sigma"))
    j = j.select("*", F.expr("(_z0 - signum(_z0) * 0.5D) / _sigma").alias("_z"))
    p = F.expr(f"CASE WHEN _n > 0 AND _sigma > 0 THEN {S.two_sided_p_sql('_z')} END")
    return j.select(*key, "n_items_used", "statistic", p.alias("p_value"))


def bonferroni(tests: DataFrame, model: str, p_col: str = "p_value") -> DataFrame:
    """p x number of comparisons of the model, at most 1."""
    m = F.count(F.lit(1)).over(Window.partitionBy(model))
    return tests.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p_col) * m))
