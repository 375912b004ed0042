"""Mixing sources to target weights (operator 3), built-in expressions only.

Every document gets an Efraimidis-Spirakis key, an exponential variate divided
by its quality weight: -ln(u) / weight with u from an MD5 of its id and size,
so reruns agree.  Documents are sorted by key within their source and their
sizes are prefix-summed to the source's budget.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, repeating;
they share `volume` (1.5) times all words by weight.  No target exceeds
`most_epochs` (2) times its source's size; the excess is reshared by weight
until none is above.  A source's budget is spent on complete epochs first,
then on the documents of least key: a document belongs to the fraction if half
of it lies within the remaining words, so the taken words miss the target by
at most half of one document.

Skew: a source may hold any share of all rows.  Keys fall into ranges of equal
ratio, so that none holds more than about one in FINENESS documents whatever
their weights; per-range sums (combined before the shuffle) find the range in
which a source's budget ends, and only that range's keys are sorted, equal rows
as one with their number.  The outcome is one cut-off key per source, so
choosing documents is a comparison.

Ties: rows of one id, size and text share a key.  If a source's budget ends
among such rows, as many of them are taken as it holds; these rows alone are
numbered, by a range sort that spreads equal rows.

Defined results: null text is empty (size 0); null source is a source of its
own; documents of size 0 take 0 words; a source without words has target 0;
repeated rows and rows without an id are taken row by row (rows that differ in
no column are alike, so it doesn't matter which); an empty table gives an empty
result.  Columns other than those named are kept by
:func:`mixed_documents` and ignored by :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, null_safe_join, numbered, text_of, written

WEIGHTS = (5, 2, 1)
VOLUME_PERCENT = 150
MOST_EPOCHS = 2
SEED = "mix-1"
FINENESS = 16_384
JUNK = r"[#*$%&|<>!]"


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(
        F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are no junk symbols, to the eighth power, at least 1/256 (an empty text: 1)."""
    n = F.length(text)
    clean = (F.length(F.regexp_replace(text, JUNK, "")) + 1) / (n + 1)
    return F.greatest(_eighth(clean), F.lit(1 / 256))


def _eighth(x: Column) -> Column:
    second = x * x
    fourth = second * second
    return fourth * fourth


def keyed(docs: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    """Adds size, key, __id (tie-break) and __bucket to documents."""
    d = docs.withColumn("__text", text_of(text))
    d = d.withColumns({"size": size_of(F.col("__text")),
                       "__weight": weight if weight is not None else quality_weight(F.col("__text")),
                       "__digest": F.md5("__text")}).drop("__text")
    d = d.withColumn("__id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size"))
    # 52 bits of the digest, in (0, 1]
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), "__id")), 1, 13), 16, 10).cast("double") + 1) / 2.0 ** 52
    d = d.withColumn("key", -F.log(u) / F.col("__weight")).withColumn("__id", F.concat_ws(":", "__id", "__digest"))
    return d.withColumn("__bucket", F.coalesce(  # the logarithm of key 0 is null
        F.floor(F.log("key") * FINENESS).cast("int"), F.lit(-(1 << 31)))).drop("__digest")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, volume_percent: int = VOLUME_PERCENT,
            most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with weight and target.  The cap is raised source by source: each round caps
    all sources whose share is above it; a round only reads two sums on the driver."""
    spark = sizes.sparkSession
    n = numbered(sizes, [F.col("source").asc_nulls_last()], "__n")
    cycle = F.array(*[F.lit(w) for w in weights])
    s = written(n.select("source", "source_size",
                         F.get(cycle, (F.col("__n") % len(weights)).cast("int")).cast("long").alias("weight")), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    budget = total * volume_percent / 100
    limit = most_epochs * F.col("source_size")
    share, open_weight = budget, None
    while True:
        above = F.lit(False) if open_weight is None else \
            F.col("weight") * F.lit(float(share)) >= limit.cast("double") * F.lit(float(open_weight))
        row = s.agg(F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        capped, weight = row[0] or 0, row[1] or 0
        if open_weight is not None and weight == open_weight or weight == 0:
            break
        share, open_weight = budget - capped, weight
    above = F.col("weight") * F.lit(float(share)) >= limit.cast("double") * F.lit(float(open_weight or 1))
    target = F.when(above | F.lit(weight == 0), limit.cast("double")).otherwise(
        F.col("weight") * F.lit(float(share)) / F.lit(float(open_weight or 1)))
    return s.withColumn("target", target)


def cut_offs(docs: DataFrame, aims: DataFrame) -> DataFrame:
    """Per source: complete epochs, the range (__last) in which the budget ends, and the last key of the fraction
    (__cut; null: none in that range) with how many (__cut.m) of its __cut.n rows are taken.
    `docs` needs source, size, key, __id, __bucket; `aims` is the result of :func:`targets`."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = docs.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    at = null_safe_join(sums, aims.select("source", "rest"), ["source"]).where("__before <= rest").groupBy("source").agg(
        F.max(F.struct("__bucket", "__before", "rest")).alias("__at"))
    last = null_safe_join(docs.select("source", "size", "key", "__id", "__bucket"),
                          at.select("source", F.col("__at.__bucket").alias("__last"), "__at.__before", "__at.rest"),
                          ["source"]).where("__bucket = __last")
    last = last.groupBy("source", "key", "__id", "size", "__before", "rest").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("source").orderBy("key", "__id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("__before") - F.coalesce(F.sum(F.col("size") * F.col("__n")).over(earlier), F.lit(0))
    last = last.withColumn("__left", left)
    # the j-th row is taken if its middle, (j - 1/2) sizes further, lies within the rest
    holds = F.when(F.col("size") == 0, F.when(F.col("__left") >= 0, F.col("__n")).otherwise(0)).otherwise(
        F.floor(F.col("__left") / F.greatest("size", F.lit(1)) + 0.5))
    last = last.withColumn("__m", F.least(holds, "__n")).where("__m > 0")
    cut = last.groupBy("source").agg(
        F.max(F.struct("key", "__id", F.col("__m").alias("m"), F.col("__n").alias("n"))).alias("__cut"))
    out = null_safe_join(aims, at.select("source", F.col("__at.__bucket").alias("__last")), ["source"], "left")
    return null_safe_join(out, cut, ["source"], "left")


def chosen(docs: DataFrame, cuts: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds target, source_size, copies and taken to keyed documents.  `cuts` is a written table: it is asked
    first whether any source's budget ends among equal rows."""
    columns = docs.columns
    d = null_safe_join(docs, cuts, ["source"], "left")
    place, cut = F.struct("key", "__id"), F.struct("__cut.key", "__cut.__id")
    inside = F.col("__bucket") == F.col("__last")
    picked = (F.col("__bucket") < F.col("__last")) | (inside & (place <= cut))
    if cuts.where("__cut.m < __cut.n").take(1):
        torn = F.coalesce(inside & (place == cut) & (F.col("__cut.m") < F.col("__cut.n")), F.lit(False))
        alike = written(d.where(torn).withColumn("__row", F.monotonically_increasing_id()), "alike")
        alike = numbered(alike, [F.col("source"), F.xxhash64(F.struct(*columns).cast("string")), F.col("__row")], "__number")
        first = alike.groupBy("source").agg(F.min("__number").alias("__first"))
        alike = null_safe_join(alike, first, ["source"]).withColumn(
            "__in", F.col("__number") - F.col("__first") < F.col("__cut.m"))
        d = d.where(~torn).withColumn("__in", picked).unionByName(alike.drop("__row", "__number", "__first"))
        picked = F.col("__in")
    copies = F.least(F.col("epochs") + F.coalesce(picked, F.lit(False)).cast("long"), F.lit(most_epochs))
    d = d.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return d.drop("__bucket", "__last", "__cut", "__id", "__in", "__weight", "epochs", "rest", "weight")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, with copies, source and key, for every document."""
    d = written(keyed(docs.select("doc_id", "source", "text")).drop("text", "__weight"), "keyed")
    cuts = cut_offs(d, targets(d.groupBy("source").agg(F.sum("size").alias("source_size"))))
    return chosen(d, written(cuts, "cuts")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source", "key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the documents' own columns."""
    columns = docs.columns
    d = written(keyed(docs.select("doc_id", "source", "text")).drop("text", "__weight"), "keyed")
    cuts = written(cut_offs(d, targets(d.groupBy("source").agg(F.sum("size").alias("source_size")))), "cuts")
    full = docs.select(F.struct(*columns).alias("__doc"), "doc_id", "source", "text")
    out = chosen(keyed(full), cuts).where("copies > 0")
    return out.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")
