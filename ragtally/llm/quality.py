"""Quality rules with adaptive thresholds (operator 2), built-in expressions only.

Four ratios of a text (symbols per word character, repeated lines per line,
words in repeated eight-word windows per word, characters per word) are held
against limits learned from the corpus itself, per language and source, instead
of fixed cut-offs.  The upper limit is the larger of the fence Q3 + FENCE *
(Q3 - Q1) and the ratio's own upper quantile (UPPER: most texts have no repeats
at all, so quartiles alone say nothing about them); the word length also has
the lower fence Q1 - FENCE * (Q3 - Q1).  Only documents that pass the base rule
are learned from: what the base takes anyway must not widen the limits.

Quantiles come from mergeable sketches: a ratio in millionths is rounded down
to six significant bits (a relative error below 1/32) and counted per group.  A
sketch has at most some 600 counters whatever the group's size; sketches merge
by adding counts, which Spark does before the shuffle, so a hot source is no
hot key.  Counts are exact integers: reruns agree.  Limits are widened by the
sketch's resolution, no more.

Few documents say little about a tail: a group's limit is the mean of its own,
weighted by its documents, and its language's, weighted by PRIOR documents; the
language's likewise leans on that of all documents.  One formula at every size.

The verdict joins each document's ratios with its group's limits.

Defined results: null text has no words (base_failed); null language and null
source are groups of their own; repeated rows count each; a group of which no document
passes the base rule has no limits and keeps nothing; very long texts count as
one document like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, null_safe_join, text_of, words, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT_PERCENT = 30
FENCE = 3
PRIOR = 50
SYMBOLS = r"[#*$%&|<>]"
#: ratio -> percent of the documents that its limit keeps at least
UPPER = {"symbols": 90, "lines": 99, "repeats": 99, "word_length": 75}
#: ratios with a lower fence
BOTH_SIDES = ("word_length",)


def repeated_window_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words found twice or more, from the words' hashes."""
    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

        def length(p: Column) -> Column:  # p: places in order
            steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        places = let(placed, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        return let(places, length)

    body = let(windows(hashes), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(hashes) >= WINDOW, body).otherwise(0).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """The counts of each document, with lang and source."""
    space = r"[\x20\x09-\x0D]+"
    d = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    d = d.select("*", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
                 F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, space, "")) > 0).alias("lines"))
    return d.select(
        "doc_id", "lang", "source", F.size("hashes").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", space, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("hashes")).alias("n_repeat_words"))


def with_ratios(f: DataFrame) -> DataFrame:
    """Adds the ratios in millionths (integer division)."""
    def ratio(a: str, b: str) -> Column:
        return F.expr(f"({a} * 1000000) div greatest({b}, 1)")

    return f.withColumns({
        "symbols": ratio("n_symbols", "word_chars"), "lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"), "word_length": ratio("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))})


def bucket(value: Column) -> Column:
    """Value rounded down to six significant bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, _low(value)), _low(value))


def _low(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - 6, F.lit(0))


def sketches(f: DataFrame) -> DataFrame:
    """Counts per (lang, source, ratio, bucket) over the documents that pass the base rule."""
    ratios = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(F.col(r)).alias("bucket")) for r in UPPER]))
    return f.where("not base_failed").select("lang", "source", ratios.alias("r")).groupBy("lang", "source", "r.ratio", "r.bucket").agg(
        F.count("*").alias("n"))


def own_limits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """n, high and low of each group's merged sketch, per ratio."""
    merged = counts.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "ratio")
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    m = merged.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(w)})
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("all"), F.col("bucket")))
    tail = F.element_at(F.create_map(*[F.lit(x) for r in UPPER.items() for x in r]), F.col("ratio"))
    q = m.groupBy(*keys, "ratio").agg(at(25).alias("q1"), at(75).alias("q3"), at(tail).alias("tail"),
                                      F.max("all").alias("n"))
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.expr("q3 div 32"))
    high = F.greatest(F.col("q3") + spread, F.col("tail")) + 1
    return q.select(*keys, "ratio", "n", high.alias("high"), (F.col("q1") - spread).alias("low")).withColumn(
        "high", F.expr("high + high div 32"))


def limits(counts: DataFrame) -> DataFrame:
    """One row per (lang, source): low and high limit of each ratio."""
    def leaning(mine: DataFrame, on: DataFrame, keys: list[str]) -> DataFrame:
        wide = on.select(*keys, F.col("high").alias("__high"), F.col("low").alias("__low"))
        mean = lambda c: F.floor((F.col("n").cast("double") * F.col(c) + F.lit(float(PRIOR)) * F.col(f"__{c}"))
                                 / (F.col("n") + PRIOR)).cast("long")
        return null_safe_join(mine, wide, keys).withColumns({"high": mean("high"), "low": mean("low")}).drop(
            "__high", "__low")

    lang = leaning(own_limits(counts, ["lang"]), own_limits(counts, []), ["ratio"])
    group = leaning(own_limits(counts, ["lang", "source"]), lang, ["lang", "ratio"])
    mine = lambda r, c: F.max(F.when(F.col("ratio") == r, F.col(c))).alias(f"{r}_{c}")
    return group.groupBy("lang", "source").agg(
        *[mine(r, "high") for r in UPPER], *[mine(r, "low") for r in BOTH_SIDES])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the ratios."""
    f = with_ratios(written(features(docs), "features"))
    marks = null_safe_join(f, written(limits(written(sketches(f), "sketches")), "limits"), ["lang", "source"], "left")
    fine = F.lit(True)
    for r in UPPER:
        fine = fine & (F.col(r) <= F.col(f"{r}_high"))
    for r in BOTH_SIDES:
        fine = fine & (F.col(r) >= F.col(f"{r}_low"))
    return marks.withColumn("kept", ~F.col("base_failed") & fine).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *UPPER)
