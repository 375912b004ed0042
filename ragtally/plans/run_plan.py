"""Run plans: the list of evaluation runs (model x permutation x repeat x
retrieval mode) with their output names, and the metric description sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Experiment-1 retrieval modes as (label, vector store
# parameter, retrieval type); the text mode searches the text store with the
# dense retriever type.
EXP1_MODES = (("no_RAG", "", ""), ("text_RAG", "vd_text", "mm_RAG"), ("mm_RAG", "vd_mm", "mm_RAG"),
              ("colpali", "vd_colpali", "colpali"))
PERM_SETTINGS = ((True, "perm"), (False, "no_perm"))
PERMUTE_WORDS = ("yes", "true", "1")


def should_permute(flag) -> Column:
    """Permutation switch from text: yes / true / 1 in any case."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.lower(c).isin(*PERMUTE_WORDS)


def exp1_plan(models: DataFrame, model_short: str, repeats: int, stores: dict[str, str]) -> DataFrame:
    """One row per (model, permutation, repeat, mode) with the output stub
    'eval_{model}_{mode}_{perm|no_perm}_benchmark' and the '--perm_quest'
    value.  Expanded with explode over the fixed lists (no join)."""
    perms = F.array(*[F.struct(F.lit(p).alias("permute"), F.lit(lbl).alias("perm_label")) for p, lbl in PERM_SETTINGS])
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(stores.get(v, "")).alias("vector_db"),
                               F.lit(t).alias("eval_type")) for m, v, t in EXP1_MODES])
    out = (models.select(model_short, F.explode(perms).alias("p"))
           .select(model_short, "p.*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
           .select("*", F.explode(modes).alias("m")).select(model_short, "permute", "perm_label", "repeat", "m.*"))
    stub = F.concat(F.lit("eval_"), F.col(model_short), F.lit("_"), F.col("mode"), F.lit("_"), F.col("perm_label"),
                    F.lit("_benchmark"))
    return (out.withColumn("output_stub", stub)
            .withColumn("perm_quest", F.when(F.col("permute"), F.lit("Yes")).otherwise(F.lit(""))))


def exp2_plan(generators: DataFrame, generator: str, retrievers: Sequence[str], iterations: int) -> DataFrame:
    """generator x retriever x iteration rows (explode over the parameters)."""
    return (generators.select(generator, F.explode(F.array(*[F.lit(r) for r in retrievers])).alias("retriever"))
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration")))


# Metric descriptions of the CI report; '{k}' is the top-k.
METRIC_DESCRIPTIONS = (
    ("Cor_answer", "Average correctness rate per question"),
    ("Elapsed", "Average wall-clock time per question (seconds)"),
    ("Total_tokens", "Average total tokens consumed per question"),
    ("P@{k}", "Precision@{k}: share of retrieved documents containing the reference paper"),
    ("Throughput", "Average tokens processed per second"),
    ("Cost", "USD spent per iteration/run"),
    ("Price-per-cost", "Cents spent per correct answer"),
)


def metric_descriptions(k: int) -> list[tuple[str, str]]:
    return [(m.format(k=k), d.format(k=k)) for m, d in METRIC_DESCRIPTIONS]


def description_column(metric: Column, k: int) -> Column:
    """Description text of a metric display name (literal map lookup)."""
    pairs = metric_descriptions(k)
    m = F.create_map(*[x for name, text in pairs for x in (F.lit(name), F.lit(text))])
    return F.element_at(m, metric)
