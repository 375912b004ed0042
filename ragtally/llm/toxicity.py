"""Toxicity by class-conditional Kneser-Ney models (operator 7).

Two unigram models, toxic and ordinary, over hashed lower-cased expressions
(words without ASCII punctuation).  A document's value is the difference of the
two models' log-likelihoods, over all its words, divided by their number; a
logistic curve fitted on documents that gave no counts turns it into a score.

Counts.  Every labelled training document gives each of its words min(count,
MOST_OF_WORD), scaled so that a document counts for at most FULL_LENGTH words
(long documents don't make their language ordinary).  Copies, documents of a
class with the same expressions in the same order, count as one: their counts
are equal, so one of them is summed, whatever their number.  Counts are integers
in units of 1 / UNIT, so fine that no word of a document rounds to nothing,
summed in Spark: they grow with the input and sum to the same in any order.

Smoothing.  Both models discount their counts absolutely and give the discounted
mass to the shared backoff: an expression's continuation count, the number of
different expressions before it (the text's start is one) in the documents of
both classes, over the sum of all of these.  The ordinary model's discount is
that which gives the backoff as much weight as in the toxic model.  So a word
whose counts do not reach the discounts is as likely in both models, by the
models themselves: no ratio is cut off and no expression left out.  The discount
is the one of DISCOUNTS with the least logarithmic loss on the curve's fold; all
of them are tried, whatever the number of expressions.

Counts and ratios are kept by the full 64-bit hash of the expression in Spark
tables that grow with the corpus: expressions share no slots.  Of the
expressions whose ratio is not 0, the most frequent, up to MOST_SENT, are sent to
the tasks; the ratios of the others stay a table, which is joined with the
expressions of the texts that hold any.  A value sums both, so it doesn't depend
on MOST_SENT.

Learning uses labels of rows whose crc32(doc_id as text) mod 5 is not 0: fold 4
for the curve (all of its rows, by sums in Spark for each Newton step), the others
for counts.

Defined results: null and empty texts have value 0, as any text of unknown words;
label rows with null toxic or null id are not used; of repeated label rows the
highest counts; repeated documents count once more each, as copies; without
labels of both classes all scores are the empty text's, 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..session import ship_package
from .common import likely, slots, text_of, written
from .wordhash import word_hashes

FOLDS, HELD_OUT, CURVE_FOLD = 5, 0, 4
MOST_OF_WORD = 3
FULL_LENGTH = 300
#: 1 at up to 10^10 words a document; 10^9 documents of full length sum below 2^63
UNIT = 1 << 24
#: Of the toxic counts; what the ordinary counts are discounted by follows
DISCOUNTS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
#: Expressions that are sent to the tasks; more are joined
MOST_SENT = 1 << 20
#: Joined ratios, each times its share of a text's words, are summed in units of 1 / FINE: to the same in any order
FINE = 1 << 50
#: Steps of the ordinary counts' histogram for each doubling of the count
STEPS = 32
#: Expressions that are summed at once
PORTION = 1 << 21

# ASCII: letters in lower case, digits stay, the rest separates; other bytes stay
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def expressions(text: str) -> np.ndarray:
    return word_hashes(text.encode().translate(_PLAIN))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    """Keys of the counts: the whole hash, as Spark's long."""
    return hashes.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct expressions of each text and their counts up to MOST_OF_WORD, its length, and a digest of them all."""
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            h = expressions(text)
            bucket, n = np.unique(_buckets(h), return_counts=True)
            out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), bucket.tobytes(),
                        np.minimum(n, MOST_OF_WORD).astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(
                (pa.int64(), pa.binary(), pa.binary(), pa.binary())))], names=["doc_id", "n", "mark", "buckets", "counts"])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each text's expressions, and the text, compressed (smaller than its expressions)."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        texts = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([xxhash.xxh3_128_digest(expressions(t).tobytes()) for t in texts], pa.binary()),
             pa.array([pack(t.encode()) for t in texts], pa.binary())], names=["doc_id", "mark", "packed"])


def _texts_of(b: pa.RecordBatch) -> list[str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x).decode() for x in b.column("packed").to_pylist()]


def _packed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(_texts_of(b), pa.string())], names=["doc_id", "text"])
            for b in batches)
    return _sums(f.rename_columns(["toxic", *f.schema.names[1:]]) for f in _features(rows))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The expressions, and those before them (the start: 0), each pair once in a portion of the documents."""
    def distinct(parts: list[np.ndarray]) -> pa.RecordBatch:
        pair = np.concatenate(parts, axis=1)
        pair = pair[:, np.lexsort(pair)]
        pair = pair[:, np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)))]
        return pa.RecordBatch.from_arrays([pa.array(pair[1]), pa.array(pair[0])], names=["bucket", "before"])

    parts, size = [], 0
    for b in batches:
        for text in _texts_of(b):
            h = _buckets(expressions(text))
            if len(h):
                parts.append(np.stack((np.concatenate((np.zeros(1, np.int64), h[:-1])), h)))
                size += len(h)
            if size >= PORTION:
                yield distinct(parts)
                parts, size = [], 0
    if size:
        yield distinct(parts)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counts by bucket, in units, of a portion of the documents at a time."""
    def summed(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        total = np.zeros((2, len(bucket)), dtype=np.int64)
        kind = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        np.add.at(total, (kind, at), np.concatenate([p[2] for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[0]), pa.array(total[1])],
                                          names=["bucket", "ordinary", "toxic"])

    parts, size = [], 0
    for b in batches:
        for n, toxic, bucket, count in zip(*(b.column(c).to_pylist() for c in (
                "n", "toxic", "buckets", "counts")), strict=True):
            weight = UNIT * min(1.0, FULL_LENGTH / max(n, 1))
            c = np.rint(np.frombuffer(count, dtype=np.uint8) * weight).astype(np.int64)
            parts.append((int(toxic != 0), np.frombuffer(bucket, dtype=np.int64), c))
            size += len(c)
            if size >= PORTION:
                yield summed(parts)
                parts, size = [], 0
    if size:
        yield summed(parts)


def logistic(values: np.ndarray, slope: float, middle: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * (values - middle), -30, 30)))


class Model:
    """Log ratio of the two models by expression, and the score curve.  The tasks get the ratios in the arrays; those of
    `rest` (bucket, r0, r1, ...: a column of the ratios each) stay a table."""

    def __init__(self, buckets: np.ndarray, ratios: np.ndarray, slope: float = 200.0, middle: float = 0.02,
                 rest: DataFrame | None = None):
        order = np.argsort(buckets)
        self.buckets, self.ratios, self.slope, self.middle = buckets[order], ratios[order], slope, middle
        self.rest = rest

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def _sent(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the arrays, and which of the hashes are there."""
        if not len(self.buckets):
            return np.zeros(len(h), np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.buckets, h), len(self.buckets) - 1)
        return at, self.buckets[at] == h

    def values(self, text: str) -> np.ndarray:
        """Difference of log-likelihoods per word, for each column of the ratios, of the expressions that are sent."""
        h = _buckets(expressions(text))
        if not len(h):
            return np.zeros(self.ratios.shape[1:])
        at, sent = self._sent(h)
        return self.ratios[at[sent]].sum(axis=0) / len(h)

    def value(self, text: str) -> float:
        value, h = float(self.values(text)), _buckets(expressions(text))
        if self.rest is not None and len(h):
            bucket, n = np.unique(h, return_counts=True)
            count = dict(zip(bucket.tolist(), n.tolist(), strict=True))
            value += sum(r.r0 * count[r.bucket] for r in self.rest.where(F.col("bucket").isin(list(count))).collect()) / len(h)
        return value

    def list_values(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Values of the expressions that are sent, instead of the text."""
        for b in batches:
            values = [np.atleast_1d(self.values(t)).tolist() for t in b.column("text").to_pylist()]
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(values, pa.list_(pa.float64()))],
                                             names=[*keep, "values"])

    def unsent(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The expressions of each text that are not sent, and what share of its words each is."""
        def rows(keys: pa.Array, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            row = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), pa.array(np.concatenate([p[1] for p in parts])),
                 pa.array(np.concatenate([p[2] for p in parts]))], names=["__key", "bucket", "share"])

        for b in batches:
            parts, size = [], 0
            for i, text in enumerate(b.column("text").to_pylist()):
                h = _buckets(expressions(text))
                bucket, n = np.unique(h, return_counts=True)
                other = ~self._sent(bucket)[1]
                if other.any():
                    parts.append((i, bucket[other], n[other] / len(h)))
                    size += len(parts[-1][1])
                if size >= PORTION:
                    yield rows(b.column("__key"), parts)
                    parts, size = [], 0
            if size:
                yield rows(b.column("__key"), parts)

    def measured(self, docs: DataFrame) -> DataFrame:
        """The rows with `values`, for each column of the ratios, instead of their `text`."""
        ship_package(docs.sparkSession)
        columns = [c for c in docs.columns if c != "text"]
        if self.rest is None:
            return docs.mapInArrow(self.list_values, _valued(docs))
        keyed = docs.withColumn("__key", F.unhex(F.md5("text")))
        found = keyed.select("__key", "text").mapInArrow(self.unsent, "__key binary, bucket long, share double")
        # equal texts once
        found = likely(found, self.rest, slots(self.rest.count()), "bucket").dropDuplicates(["__key", "bucket"])
        sums = found.join(self.rest, "bucket").groupBy("__key").agg(F.array(*[
            F.sum(F.round(F.col(c) * F.col("share") * F.lit(FINE)).cast("long")) / F.lit(FINE)
            for c in self.rest.columns[1:]]).alias("rest"))
        # written, so that the join reads plain exchanges and a text with many copies can be split among tasks
        d = keyed.mapInArrow(self.list_values, _valued(keyed)).join(written(sums, "toxicity-rest"), "__key", "left")
        whole = F.when(F.col("rest").isNull(), F.col("values")).otherwise(F.zip_with("values", "rest", lambda a, b: a + b))
        return d.select(*columns, whole.alias("values"))

    def scored(self, docs: DataFrame) -> DataFrame:
        """The rows with `score` instead of their `text`."""
        d = self.measured(docs)
        at = F.lit(self.slope) * (F.get(F.col("values"), F.lit(0)) - F.lit(self.middle))
        score = 1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-30.0)), F.lit(30.0))))
        return d.select(*[c for c in d.columns if c != "values"], score.alias("score"))


def _valued(docs: DataFrame) -> StructType:
    """The schema of the rows with values instead of a text."""
    return StructType([f for f in docs.schema.fields if f.name != "text"]).add("values", ArrayType(DoubleType()))


def curve_sums(x: np.ndarray, toxic: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the gradient (2) and of the second derivatives (3) of the logistic loss at w."""
    p = 1 / (1 + np.exp(-np.clip(x * w[0] + w[1], -30, 30)))
    off, q = p - toxic, p * (1 - p)
    return np.array((x @ off, off.sum(), (q * x) @ x, q @ x, q.sum()))


def _newton(scales: list[float], sums_at: Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]]
            ) -> list[tuple[float, float] | None]:
    """Slope and middle of a logistic curve for each column of values (Newton steps, slightly regularised); None if the
    values fall with the class.  `sums_at` gives :func:`curve_sums` for the parameters of some of the columns."""
    at, todo = [np.zeros(2) for _ in scales], set(range(len(scales)))
    for _ in range(50):
        for i, (g0, g1, h00, h01, h11) in sums_at({i: at[i] for i in sorted(todo)}).items():
            hess = np.array(((h00 + 0.05, h01), (h01, h11 + 1e-6)))
            step = np.linalg.solve(hess, np.array((g0, g1)) + np.array((0.05, 1e-6)) * at[i])
            at[i] = at[i] - step / max(1.0, float(np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                todo.discard(i)
        if not todo:
            break
    return [(float(w[0] / scale), float(-w[1] / w[0] * scale)) if w[0] > 0 else None for w, scale in zip(at, scales, strict=True)]


def fit_curve(values: np.ndarray, toxic: np.ndarray) -> tuple[float, float] | None:
    """Slope and middle of a logistic curve; None without both classes."""
    if len(set(toxic.tolist())) < 2:
        return None
    scale = max(float(values.std()), 1e-6)
    return _newton([scale], lambda at: {i: curve_sums(values / scale, toxic, w) for i, w in at.items()})[0]


def fit_curves(values: DataFrame, columns: int) -> dict[int, tuple[float, float]]:
    """The curve for each column of a written table (values, toxic 0 or 1), by sums over all of its rows; a column
    without a curve is left out."""
    column = [F.get("values", F.lit(i)) for i in range(columns)]
    row = values.agg(F.min("toxic"), F.max("toxic"), *[F.stddev_pop(c) for c in column]).first()
    if row[0] == row[1]:
        return {}
    scales = [max(x, 1e-6) for x in row[2:]]
    found = _newton(scales, lambda at: _totals(values, {
        i: lambda v, toxic, w=w, scale=scales[i]: curve_sums(v / scale, toxic, w) for i, w in at.items()}))
    return {i: curve for i, curve in enumerate(found) if curve}


def _totals(values: DataFrame, sums: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> dict[int, np.ndarray]:
    """For each of these columns of a table (values, toxic), the function's sums over all rows."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.array(b.column("values").to_pylist(), dtype=float)
                toxic = b.column("toxic").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums), pa.int32()),
                     pa.array([f(v[:, i], toxic).tolist() for i, f in sums.items()], pa.list_(pa.float64()))], names=["i", "sums"])

    d = values.mapInArrow(parts, "i int, sums array<double>").select("i", F.posexplode("sums").alias("k", "x"))
    out: dict[int, list[float]] = {}
    for r in sorted(d.groupBy("i", "k").agg(F.sum("x").alias("x")).collect()):
        out.setdefault(r.i, []).append(r.x)
    return {i: np.array(x) for i, x in out.items()}


def _discounts(hist: list[tuple[int, int, int]], mass: int, shares: list[float]) -> list[float]:
    """Discounts that take these shares of the mass, from a histogram (step, number, sum) of the counts."""
    step, number, total = (np.array(x, dtype=float) for x in zip(*sorted(hist), strict=True))
    edge = np.append(2 ** (step / STEPS), 2 ** ((step[-1] + 1) / STEPS))
    # a discount at a step's start takes the counts below it whole, and itself from each of the others
    below = np.concatenate(([0.0], np.cumsum(total)))
    above = np.append(np.cumsum(number[::-1])[::-1], 0.0)
    taken = below + edge * above
    return np.interp(np.array(shares) * mass, np.append(0.0, taken), np.append(0.0, edge)).tolist()


@dataclass
class Smoothing:
    """For each of DISCOUNTS: the backoff's share, and by class what is taken from a count and the sum that is left;
    and the sum of all continuation counts."""

    shares: list[float]
    cuts: list[dict[str, float]]
    left: list[dict[str, float]]
    contexts: int

    def reached(self, which: Sequence[int]) -> Column:
        """Whether an expression's counts reach one of these discounts; if not, its ratios are exactly 0."""
        return F.greatest(F.lit(False), *[F.col(c) > F.lit(cut) for i in which for c, cut in self.cuts[i].items()])

    def log_ratio(self, i: int) -> Column:
        backoff = F.lit(self.shares[i]) * (F.col("contexts") / F.lit(float(self.contexts)))
        log = {c: F.log(F.lit((1 - self.shares[i]) / max(self.left[i][c], 1.0))
                        * F.greatest(F.col(c) - F.lit(cut), F.lit(0.0)) + backoff) for c, cut in self.cuts[i].items()}
        return log["toxic"] - log["ordinary"]


def smoothing(counts: DataFrame) -> Smoothing | None:
    """From `counts` (bucket, ordinary, toxic, contexts); None without counts of both classes."""
    step = F.when(F.col("ordinary") > 0, F.floor(F.log2("ordinary") * STEPS))
    bins = counts.groupBy(step.alias("step")).agg(
        F.count("*").alias("n"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"),
        F.sum("contexts").alias("contexts"),
        *[F.sum(F.least(F.col("toxic"), F.lit(int(UNIT * d)))).alias(f"cut{i}") for i, d in enumerate(DISCOUNTS)]).collect()
    mass = {c: sum(r[c] for r in bins) for c in ("ordinary", "toxic")}
    if not mass["ordinary"] or not mass["toxic"]:
        return None
    shares = [sum(r[f"cut{i}"] for r in bins) / mass["toxic"] for i in range(len(DISCOUNTS))]
    ordinary = _discounts([(r.step, r.n, r.ordinary) for r in bins if r.step is not None], mass["ordinary"], shares)
    cuts = [{"toxic": UNIT * d, "ordinary": o} for d, o in zip(DISCOUNTS, ordinary, strict=True)]
    sums = counts.agg(*[F.sum(F.greatest(F.col(c) - F.lit(cut), F.lit(0.0))).alias(f"{c}{i}")
                        for i, x in enumerate(cuts) for c, cut in x.items()]).first()
    return Smoothing(shares, cuts, [{c: sums[f"{c}{i}"] for c in x} for i, x in enumerate(cuts)], sum(r.contexts for r in bins))


def log_ratios(counts: DataFrame, smooth: Smoothing, which: Sequence[int]) -> DataFrame:
    """bucket, and the log ratios for these discounts (r0, r1, ...)."""
    return counts.select("bucket", *[smooth.log_ratio(i).alias(f"r{k}") for k, i in enumerate(which)])


def ratios(counts: DataFrame, smooth: Smoothing | None = None, which: Sequence[int] = tuple(range(len(DISCOUNTS)))
           ) -> tuple[np.ndarray, np.ndarray]:
    """The expressions of `counts` whose counts reach a discount, and a column of log ratios for each of the discounts
    (none without counts of both classes).  `counts` may be some rows of the table that `smooth` is from."""
    if smooth is None and (smooth := smoothing(counts)) is None:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    some = log_ratios(counts.where(smooth.reached(which)), smooth, which).toPandas()
    return some["bucket"].to_numpy(np.int64), some.drop(columns="bucket").to_numpy(float)


def divided(counts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent expressions, at most MOST_SENT, and the others (None: there are none).  Cut at a step of the
    frequency, so expressions that are as frequent stay together."""
    step = F.floor(F.log2(F.col("ordinary").cast("double") + F.col("toxic") + 1) * STEPS)
    bins = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)
    sizes = np.cumsum([r.n for r in bins])
    if not len(bins) or sizes[-1] <= MOST_SENT:
        return counts, None
    first_left = bins[int(np.searchsorted(sizes, MOST_SENT, side="right"))].step
    return counts.where(step > first_left), counts.where(step <= first_left)


def unfitted(counts: DataFrame, smooth: Smoothing, which: Sequence[int]) -> Model:
    """A model with a column of ratios for each of these discounts."""
    often, others = divided(counts.where(smooth.reached(which)))
    rest = None if others is None else written(log_ratios(others, smooth, which), "toxicity-ratios")
    return Model(*ratios(often, smooth, which), rest=rest)


def loss_sum(values: np.ndarray, toxic: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    p = logistic(values, *curve)
    return np.array([-np.log(np.where(toxic > 0, p, 1 - p) + 1e-300).sum()])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    ship_package(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "toxicity-labels")
    texts = docs.where(F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = likely(texts, known, slots(known.count()), "doc_id")
    packed = texts.where(fold() != CURVE_FOLD).mapInArrow(_packed_texts, "doc_id long, mark binary, packed binary")
    # both sides grow with the corpus: the same join at every size
    learn = packed.hint("merge").join(known, "doc_id")
    # members of a group are equal in all that is counted; a hot group leaves one row a task
    once = written(learn.select((F.col("toxic") != 0).cast("int").alias("toxic"), "mark", "packed").dropDuplicates(
        ["toxic", "mark"]).drop("mark"), "toxicity-texts")
    sums = once.mapInArrow(_packed_sums, "bucket long, ordinary long, toxic long").groupBy("bucket").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    contexts = once.mapInArrow(_contexts, "bucket long, before long").distinct().groupBy("bucket").agg(
        F.count("*").alias("contexts"))
    counts = written(sums.hint("merge").join(contexts, "bucket"), "counts")
    smooth = smoothing(counts)
    if smooth is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), slope=1.0, middle=30.0)
    every = unfitted(counts, smooth, range(len(DISCOUNTS)))
    held = texts.where(fold() == CURVE_FOLD).hint("merge").join(known, "doc_id").select(
        "text", (F.col("toxic") != 0).cast("int").alias("toxic"))
    values = written(every.measured(held), "toxicity-values")
    curves = fit_curves(values, len(DISCOUNTS))
    losses = _totals(values, {i: lambda v, toxic, curve=curve: loss_sum(v, toxic, curve) for i, curve in curves.items()})
    best = min(curves, key=lambda i: losses[i][0], default=0)
    model = unfitted(counts, smooth, [best])
    return Model(model.buckets, model.ratios[:, 0], *curves.get(best, ()), rest=model.rest)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    s = model.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    return s.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    columns = docs.columns
    d = docs.select(F.struct(*columns).alias("__doc"), text_of().alias("text"))
    return model.scored(d).where("score < 0.5").select("__doc.*")
