"""Run summaries: per-iteration metrics, confidence intervals, SD tables,
accuracy pivots and majority votes.

All are groupBy/agg plans: Spark runs a partial aggregate before the shuffle
(map-side combine) and a final one after it, so a hot group (one model with
a third of all rows) costs one partial row per task, not a third of the data
in one task.  The second-level aggregates run over the tiny output of the
first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import stats as S


# --------------------------------------------------------------------------
# Categories (ordering and filter)

def filter_categories(df: DataFrame, column: str, values: Sequence[str],
                      ordinal_col: str | None = None) -> DataFrame:
    """Keep rows whose `column` is in `values`; optionally add its list position.

    The category list is a small literal, so this is a filter (pushed into
    the scan when `column` comes straight from parquet) plus a literal-map
    lookup, not a join.
    """
    out = df.where(F.col(column).isin(list(values)))
    if ordinal_col:
        pos = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        out = out.withColumn(ordinal_col, F.element_at(pos, F.col(column)))
    return out


def with_eval_metrics(df: DataFrame, prices: Mapping[str, float], k: int) -> DataFrame:
    """Add Throughput, Cost and precision@k columns to evaluation rows."""
    return (df.withColumn("Throughput", M.throughput("Total_tokens", "Elapsed"))
              .withColumn("Cost", M.cost("Model", "Total_tokens", prices))
              .withColumn("Precision", M.precision_at_k("Paper_id", "Context_papers", k)))


# --------------------------------------------------------------------------
# Confidence-interval report

# Metric specs: (name, per-iteration source column, interval kind, display decimals).
# kind: "prop" = Agresti-Coull on the per-iteration values, "t" = t interval,
# "t0" = t interval with the lower bound floored at 0.
# The report's metrics, their decimals and order.
CI_METRICS = (
    ("cor_answer", "mean_cor_answer", "prop", 3),
    ("elapsed", "mean_elapsed", "t", 2),
    ("tokens", "mean_tokens", "t", 1),
    ("precision", "mean_precision", "t", 3),
    ("throughput", "mean_throughput", "t0", 1),
    ("cost", "sum_cost", "t0", 2),
    ("price_per_correct", "price_per_cost", "t0", 2),
)


def per_iteration(evals: DataFrame, keys: Sequence[str], prices: Mapping[str, float],
                  k: int = 5, models: Sequence[str] | None = None,
                  retrievers: Sequence[str] | None = None) -> DataFrame:
    """Per (keys, Iteration) means of correctness, time, tokens, precision and
    throughput; summed cost and correct answers; cents per correct answer.

    Off-list models / retrievers and null group keys are dropped, as a
    categorical group-by drops them.
    """
    df = evals
    if models is not None:
        df = filter_categories(df, "Model", models)
    if retrievers is not None:
        df = filter_categories(df, "Model_ret", retrievers)
    group = list(dict.fromkeys(list(keys) + ["Iteration"]))
    for key in group:
        df = df.where(F.col(key).isNotNull())
    df = with_eval_metrics(df, prices, k)
    agg = df.groupBy(*group).agg(
        F.avg("Cor_answer").alias("mean_cor_answer"),
        F.avg("Elapsed").alias("mean_elapsed"),
        F.avg("Total_tokens").alias("mean_tokens"),
        F.avg("Precision").alias("mean_precision"),
        F.avg("Throughput").alias("mean_throughput"),
        F.coalesce(F.sum("Cost"), F.lit(0.0)).alias("sum_cost"),
        F.sum("Cor_answer").cast("bigint").alias("correct_answers"),
    )
    return agg.withColumn(
        "price_per_cost",
        F.when(F.col("correct_answers") > 0, F.col("sum_cost") * 100 / F.col("correct_answers")))


def _q(name: str) -> str:
    return f"`{name}`"


def ci_bounds(per_iter: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over iterations of each per-iteration metric with its 95 % bounds."""
    aggs = []
    for name, src, _kind, _dec in CI_METRICS:
        aggs += [F.avg(src).alias(f"{name}_mean"),
                 F.stddev_samp(src).alias(f"{name}_sd"),
                 F.count(src).alias(f"{name}_n"),
                 F.sum(src).alias(f"{name}_sum")]
    g = per_iter.groupBy(*keys).agg(*aggs)
    # t critical values in their own projection, so each bound reads a column
    g = g.select("*", *[F.expr(S.t975_sql(f"({name}_n - 1)")).alias(f"{name}_t")
                        for name, _s, kind, _d in CI_METRICS if kind != "prop"])
    cols = [F.col(c) for c in keys]
    for name, _src, kind, _dec in CI_METRICS:
        if kind == "prop":
            low, upp = S.agresti_coull_sql(f"{name}_sum", f"{name}_n")
        else:
            low, upp = S.t_interval_sql(f"{name}_mean", f"{name}_sd", f"{name}_n", floor_zero=(kind == "t0"),
                                        tcrit=f"{name}_t")
        cols += [F.col(f"{name}_mean"), F.expr(low).alias(f"{name}_low"), F.expr(upp).alias(f"{name}_upp")]
    return g.select(*cols)


def ci_summary(evals: DataFrame, keys: Sequence[str], prices: Mapping[str, float], k: int = 5,
               models: Sequence[str] | None = None, retrievers: Sequence[str] | None = None) -> DataFrame:
    """Display table: one 'mean\\n[low, upp]' cell per metric and group."""
    bounds = ci_bounds(per_iteration(evals, keys, prices, k, models, retrievers), keys)
    cells = [F.col(c) for c in keys]
    for name, _src, _kind, dec in CI_METRICS:
        cells.append(F.expr(M.format_ci_cell_sql(f"{name}_mean", f"{name}_low", f"{name}_upp", dec)).alias(name))
    return bounds.select(*cells)


def ci_summary_wide(summary: DataFrame, keys: Sequence[str], pivot_col: str,
                    pivot_values: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unstack `pivot_col` into `{metric}_{value}` columns (fixed value list,
    so every column exists even when a value has no rows)."""
    p = summary.groupBy(*keys).pivot(pivot_col, list(pivot_values)).agg(
        *[F.first(m).alias(m) for m in metrics])
    out = [F.col(c) for c in keys]
    for v in pivot_values:
        for m in metrics:
            name = f"{v}_{m}" if len(metrics) > 1 else v
            out.append(F.col(f"`{name}`").alias(f"{m}_{v}"))
    return p.select(*out)


# --------------------------------------------------------------------------
# Two-step (per question, then per group) summaries

def two_step_summary(evals: DataFrame, keys: Sequence[str], variables: Mapping[str, str],
                     question_col: str = "Question_nr", text: bool = True) -> DataFrame:
    """Mean per question first, then mean and 95 % interval over questions.

    `variables` maps column -> "proportion" (Agresti-Coull) or "mean"
    (t interval).  'Latency' and 'Price' columns get a lower bound >= 0.
    text=True gives 'm [l-u]' cells; otherwise numeric mean/low/upp columns.
    Rows with a null key or question are left out.
    """
    per_q = evals.dropna(subset=[*keys, question_col]).groupBy(*keys, question_col).agg(*[F.avg(v).alias(v) for v in variables])
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"{v}__mean"), F.stddev_samp(v).alias(f"{v}__sd"),
                 F.count(v).alias(f"{v}__n"), F.sum(v).alias(f"{v}__sum")]
    g = per_q.groupBy(*keys).agg(*aggs)
    g = g.withColumns({f"{v}__t": F.expr(S.t975_sql(f"(`{v}__n` - 1)")) for v, kind in variables.items()
                       if kind != "proportion"})
    out = [F.col(c) for c in keys]
    for v, kind in variables.items():
        mean, n = f"`{v}__mean`", f"`{v}__n`"
        if kind == "proportion":
            low, upp = S.agresti_coull_sql(f"`{v}__sum`", n)
        else:
            low, upp = S.t_interval_sql(mean, f"`{v}__sd`", n, floor_zero=v in ("Latency", "Price"), tcrit=f"`{v}__t`")
        if text:
            out.append(F.expr(M.interval_text_sql(mean, low, upp)).alias(v))
        else:
            out += [F.col(f"{v}__mean").alias(f"mean_{v}"), F.expr(low).alias(f"ci_low_{v}"),
                    F.expr(upp).alias(f"ci_upp_{v}")]
    return g.select(*out)


def two_stage_analysis(evals: DataFrame, keys: Sequence[str], variables: Mapping[str, str],
                       iteration_col: str = "Iteration") -> DataFrame:
    """`two_step_summary` per iteration, then mean and t interval over iterations."""
    stage1 = two_step_summary(evals, list(keys) + [iteration_col], variables, text=False)
    aggs = []
    for v in variables:
        src = f"mean_{v}"
        aggs += [F.avg(src).alias(f"{v}__mean"), F.stddev_samp(src).alias(f"{v}__sd"),
                 F.count(src).alias(f"{v}__n")]
    g = stage1.groupBy(*keys).agg(*aggs)
    g = g.withColumns({f"{v}__t": F.expr(S.t975_sql(f"(`{v}__n` - 1)")) for v in variables})
    out = [F.col(c) for c in keys]
    for v in variables:
        mean = f"`{v}__mean`"
        low, upp = S.t_interval_sql(mean, f"`{v}__sd`", f"`{v}__n`", floor_zero=v in ("Latency", "Price"),
                                     tcrit=f"`{v}__t`")
        out.append(F.expr(M.interval_text_sql(mean, low, upp)).alias(v))
    return g.select(*out)


# --------------------------------------------------------------------------
# SD tables, accuracy pivots, votes

def sd_summary(evals: DataFrame, keys: Sequence[str], hit_col: str = "hit") -> DataFrame:
    """Mean and sample SD of correctness and hit per group, as 'm (SD=s)' text."""
    df = evals
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    g = df.groupBy(*keys).agg(
        F.avg("Cor_answer").alias("mean_cor"), F.stddev_samp("Cor_answer").alias("std_cor"),
        F.avg(hit_col).alias("mean_hit"), F.stddev_samp(hit_col).alias("std_hit"))
    return g.select(*keys,
                    F.expr(M.mean_sd_text_sql("mean_cor", "std_cor")).alias("Cor_answer"),
                    F.expr(M.mean_sd_text_sql("mean_hit", "std_hit")).alias("hit"))


def summary_grouping_sets(evals: DataFrame, keys: Sequence[str], extra_key: str,
                          hit_col: str = "hit") -> DataFrame:
    """Both levels (keys + extra_key, and keys alone) in one aggregation pass."""
    df = evals
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    out = (df.groupingSets([list(keys) + [extra_key], list(keys)], *keys, extra_key)
           .agg(F.grouping_id().alias("level"),
                F.avg("Cor_answer").alias("mean_cor"), F.stddev_samp("Cor_answer").alias("std_cor"),
                F.avg(hit_col).alias("mean_hit"), F.stddev_samp(hit_col).alias("std_hit"))
           # the detailed level drops rows without a value, as a group-by on it does
           .where(~((F.col("level") == 0) & F.col(extra_key).isNull())))
    return out.select(*keys, extra_key, F.col("level").cast("int").alias("level"),
                      F.expr(M.mean_sd_text_sql("mean_cor", "std_cor")).alias("Cor_answer"),
                      F.expr(M.mean_sd_text_sql("mean_hit", "std_hit")).alias("hit"))


def run_accuracy(evals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean correctness per run."""
    return evals.groupBy(*keys).agg(F.avg("Cor_answer").alias("accuracy"))


def accuracy_pivot(evals: DataFrame, keys: Sequence[str], difficulty_col: str = "Difficulty",
                   levels: Sequence[str] = ("Easy", "Medium", "Hard")) -> DataFrame:
    """Mean correctness per group with one column per difficulty level, all
    levels always present; rows with no difficulty are left out."""
    return (evals.where(F.col(difficulty_col).isNotNull())
            .groupBy(*keys).pivot(difficulty_col, list(levels)).agg(F.avg("Cor_answer")))


def majority_vote(evals: DataFrame, keys: Sequence[str], question_keys: Sequence[str]) -> DataFrame:
    """Per question a vote = correct in at least half the runs (ties win);
    then the mean vote per condition."""
    df = evals
    for c in list(keys) + list(question_keys):
        df = df.where(F.col(c).isNotNull())
    per_q = df.groupBy(*keys, *question_keys).agg(
        F.sum("Cor_answer").alias("n_correct"), F.count("Cor_answer").alias("n_runs"))
    vote = (F.col("n_correct") >= F.ceil(F.col("n_runs") / 2)).cast("int")
    return per_q.groupBy(*keys).agg(F.avg(vote).alias("majority_accuracy"))
