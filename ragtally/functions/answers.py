"""Answer handling as Column expressions: seeded option permutations, model
response parsing, un-permuting and run-file name parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import col

# The answer letters of a four-option question.
LETTERS = "ABCD"

# Run-file name layout
#   eval_{model}_{retrieval}_{perm|no_perm}_benchmark_{yyyymmdd-hhmmss}[_perm_q].{ext}
# The retrieval part is matched lazily so 'mm_RAG_no_perm' splits as
# ('mm_RAG', 'no_perm'); a greedy match would give ('mm_RAG_no', 'perm').
RUN_NAME_PATTERN = r"^eval_([^_]+)_(.+?)_(no_perm|perm)_benchmark_([0-9]{8}-[0-9]{6})$"
PERM_SUFFIX = "_perm_q"


def permutation(question_nr, seed: int = 42, enabled=True, run=None) -> Column:
    """Order of option indices 0..3 for a question: indices sorted by
    md5('{seed}:{question}:{i}'), or by md5('{seed}:{run}:{question}:{i}')
    with a run, so repeats of a question differ.  Deterministic, so reruns
    and retried tasks give the same order.  enabled=False gives the identity."""
    if enabled is False:
        return F.array(*[F.lit(i) for i in range(4)])
    q = col(question_nr).cast("string")
    if run is not None:
        q = F.concat(col(run).cast("string"), F.lit(":"), q)
    keyed = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(
        F.md5(F.concat(F.lit(f"{seed}:"), q, F.lit(":"), i.cast("string"))).alias("h"), i.alias("i")))
    perm = F.transform(F.array_sort(keyed), lambda s: s["i"])
    if enabled is True:
        return perm
    return F.when(col(enabled), perm).otherwise(F.array(*[F.lit(i) for i in range(4)]))


def shown_options(options: list, perm) -> Column:
    """Options in the order shown to the model: shown[j] = options[perm[j]]."""
    arr = F.array(*[col(o) for o in options])
    return F.transform(col(perm), lambda i: F.element_at(arr, i + 1))


def shown_correct(correct, perm) -> Column:
    """Letter under which the key's option is shown after permuting."""
    ok = col(correct).isin(*LETTERS)
    pos = F.array_position(col(perm), F.instr(F.lit(LETTERS), col(correct)) - 1)
    return F.when(ok & (pos > 0), F.substr(F.lit(LETTERS), pos.cast("int"), F.lit(1)))


def parse_answer(response) -> Column:
    """Answer letter in a raw model response, '' when none.

    null -> ''.  Exactly 'A'..'D' -> itself.  Otherwise: collapse whitespace,
    take the text after the last ':', its first 10 characters, upper-case,
    and the first A-D that is followed by any character.
    """
    r = col(response)
    tail = F.substring_index(F.trim(F.regexp_replace(r, r"\s+", " ")), ":", -1)
    head = F.upper(F.substring(tail, 1, 10))
    letter = F.regexp_extract(head, r"([ABCD]).", 1)
    return (F.when(r.isNull(), F.lit(""))
            .when(r.isin(*LETTERS), r)
            .otherwise(letter))


def unpermute_answer(letter, perm) -> Column:
    """Shown letter -> original letter: letter i maps to LETTERS[perm[i]];
    '' stays ''."""
    # instr() of '' is 1, so only single letters A-D are looked up
    # (element_at with a null index is not reliably null, so guard the lookup)
    ok = col(letter).isin(*LETTERS)
    orig = F.element_at(col(perm), F.instr(F.lit(LETTERS), col(letter))) + 1
    return F.when(ok, F.substr(F.lit(LETTERS), orig, F.lit(1))).otherwise(F.lit(""))


def with_run_name(df: DataFrame, file_name: str, prefix: str = "") -> DataFrame:
    """Add model_short, vd_name, perm_label, timestamp, perm_suffix, valid
    parsed from a run-file name.

    Each step reads the previous step's column exactly once, so when Catalyst
    inlines a step into a pushed-down filter the expression stays linear in
    size; the four groups come from one regex rewrite (groups joined by a
    separator, then split) instead of one evaluation per group."""
    d = df.withColumn("_rn_stem", F.regexp_replace(F.col(file_name), r"\.[^.]*$", ""))
    d = d.withColumn(prefix + "perm_suffix", F.col("_rn_stem").endswith(PERM_SUFFIX))
    d = d.withColumn("_rn_core", F.regexp_replace("_rn_stem", PERM_SUFFIX + "$", ""))
    d = d.withColumn(prefix + "valid", F.col("_rn_core").rlike(RUN_NAME_PATTERN))
    d = d.withColumn("_rn_parts", F.split(
        F.regexp_replace("_rn_core", RUN_NAME_PATTERN, "$1\u0001$2\u0001$3\u0001$4"), "\u0001"))
    for i, name in enumerate(("model_short", "vd_name", "perm_label", "timestamp")):
        d = d.withColumn(prefix + name, F.when(F.col(prefix + "valid"), F.col("_rn_parts").getItem(i)))
    return d.drop("_rn_stem", "_rn_core", "_rn_parts")


def extract_content(message_json) -> Column:
    """Chat message JSON -> text: a string `content` as is, a list of parts ->
    their 'text' fields concatenated, anything else (missing, object) ''."""
    v = F.try_parse_json(col(message_json))
    content = F.variant_get(v, "$.content", "variant")
    kind = F.schema_of_variant(content)
    parts = F.try_variant_get(content, "$", "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return (F.when(kind == "STRING", F.variant_get(content, "$", "string"))
            .when(kind.startswith("ARRAY"), F.coalesce(joined, F.lit("")))
            .otherwise(F.lit("")))
