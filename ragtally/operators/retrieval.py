"""Top-k retrieval: dense cosine / dot scoring, late interaction (MaxSim)
and per-query context lists.

Plan shape (exact search, as the reference's brute-force scoring), the same
for any number of points and queries:

* Both sides are blocked by a shuffle.  Points go to shards of at most about
  ``SHARD_VALUES`` numbers, dealt by space (:class:`SpaceShards`): a query
  visits the shards whose bound reaches its kth score.  The bound of a page
  comes from the centres its patches lie nearest to.  Only ids and vectors
  travel.
* A shard's points become one matrix; queries stream past it in blocks of
  ``QUERY_BLOCK``, each scored by one matrix product, and only the best k of a
  query in a shard leave the task.  Memory is one shard and one block.
* ``row_number() <= k`` per query, planned with a map-side
  ``WindowGroupLimit``, merges the shards' answers; payload columns are joined
  to these k x queries rows afterwards.
* An owner (tenant) is part of the shard key, so rows of other owners are
  never scored.

A dense vector is a page with one patch, and a question one with one token:
dense and late-interaction search share their code.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

# Numbers of a shard's vectors (32 MiB as doubles).
SHARD_VALUES = 1 << 22
# Queries scored together (score matrix memory).
QUERY_BLOCK = 256


def top_k(scored: DataFrame, k: int, query_id: str = "query_id", score: str = "score",
          tie: str = "point_id", rank_col: str = "rank") -> DataFrame:
    """k best rows per query: score descending, ties by `tie` ascending."""
    w = Window.partitionBy(query_id).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# --------------------------------------------------------------------------
# Blocked exact scoring

def _matrices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of a batch's items, one per row, and the number of vectors of each item."""
    inner = column.flatten()
    flat = np.asarray(inner.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(inner), -1) if len(inner) else np.zeros((0, 0)), column.value_lengths().to_numpy()


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def best_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best columns of each row, best first, equal scores by smaller column."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class _ScoreShards:
    """Scores the shards of a partition.  Rows come sorted by shard and owner, a shard's points before its queries."""

    def __init__(self, k: int, cosine: bool):
        self.k, self.cosine = k, cosine

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for b in batches:
            marks = list(zip(*(b.column(c).to_pylist() for c in ("shard", "owner", "is_query")), strict=True))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if marks[lo][:2] != key:
                    key, parts, shard = marks[lo][:2], [], None
                if not marks[lo][2]:
                    parts.append(part)
                elif parts:
                    shard = shard or self._load(parts)
                    for i in range(0, part.num_rows, QUERY_BLOCK):
                        yield self._score(shard, part.slice(i, QUERY_BLOCK))

    def _load(self, parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts).sort_by("point_id").combine_chunks()
        vectors, sizes = _matrices(t.column("v").combine_chunks())
        return t.column("point_id"), _unit(vectors) if self.cosine else vectors, np.cumsum(sizes) - sizes

    def _score(self, shard: tuple, queries: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors, starts = shard
        tokens, sizes = _matrices(queries.column("v"))
        tokens = _unit(tokens) if self.cosine else tokens
        per_page = np.maximum.reduceat(tokens @ vectors.T, starts, axis=1)
        scores = np.add.reduceat(per_page, np.cumsum(sizes) - sizes, axis=0)
        row, column = best_k(scores, self.k)
        return pa.RecordBatch.from_arrays(
            [queries.column("query_id").take(pa.array(row)), ids.take(pa.array(column)).combine_chunks(),
             pa.array(scores[row, column])], names=["query_id", "point_id", "score"])


def _blocked_top_k(points: DataFrame, queries: DataFrame, k: int, cosine: bool, on: Sequence[str]) -> DataFrame:
    """points (point_id, v, *on), queries (query_id, v, *on), v an array of vectors -> query_id, point_id, score
    of the k best.  Items without vectors are left out."""
    ship_package(points.sparkSession)
    some = (F.size("v") > 0) & (F.size(F.col("v")[0]) > 0)
    points, queries = points.where(some), queries.where(some)
    values = points.agg(F.sum(F.size("v").cast("long") * F.size(F.col("v")[0]))).first()[0] or 0
    shards = max(1, -(-values // SHARD_VALUES))
    owner = F.to_json(F.struct(*on), {"ignoreNullFields": "false"}) if on else F.lit("")
    known = None
    for c in on:  # null owners match nobody
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    if on:
        points, queries = points.where(known), queries.where(known)
    points = points.select(F.pmod(F.xxhash64("point_id"), F.lit(shards)).cast("int").alias("shard"), owner.alias("owner"), "point_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), owner.alias("owner"), "query_id", "v")
    return top_k(_scored(points, asked, k, cosine, int(shards) if not on else max(int(shards), 8)), k)


def _scored(points: DataFrame, asked: DataFrame, k: int, cosine: bool, parts: int) -> DataFrame:
    """The best k of each asked query (shard, owner, query_id, v) in each shard of points (shard, owner, point_id, v).
    Vectors travel as they are stored (doubles if the sides differ); the tasks compute in doubles."""
    qid, pid = asked.schema["query_id"].dataType, points.schema["point_id"].dataType
    kinds = {d.schema["v"].dataType.simpleString() for d in (points, asked)}
    v = F.col("v").cast(kinds.pop() if len(kinds) == 1 else "array<array<double>>").alias("v")
    rows = points.select("shard", "owner", F.lit(False).alias("is_query"), "point_id", F.lit(None).cast(qid).alias("query_id"),
                         v)
    rows = rows.union(asked.select("shard", "owner", F.lit(True).alias("is_query"), F.lit(None).cast(pid).alias("point_id"),
                                   "query_id", v))
    return rows.repartition(parts, "shard", "owner").sortWithinPartitions("shard", "owner", "is_query").mapInArrow(
        _ScoreShards(k, cosine), f"query_id {qid.simpleString()}, point_id {pid.simpleString()}, score double")


# --------------------------------------------------------------------------
# Shards by space

# Most cells of the space, and most centres: these and their distances go to the tasks.
MOST_CELLS = 1024
# Centres of the bounds for pages of several patches, where the cells are fewer.
PATCH_CENTRES = 256
# Vectors compared with the centres together.
VECTOR_BLOCK = 4096


class _Cells:
    """The first `cells` centres are cells, which items are dealt to; `reach` holds for each cell the centres its items'
    vectors lie nearest to, each with the greatest distance of such a vector."""

    def __init__(self, centres: np.ndarray, cells: int, cosine: bool):
        self.centres, self.cells, self.cosine = centres, cells, cosine
        self.lengths = np.linalg.norm(centres, axis=1)
        self.reach: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _vectors(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, vectors an item, and where an item's begin."""
        x, sizes = _matrices(b.column("v"))
        return _unit(x) if self.cosine else x, sizes, np.cumsum(sizes) - sizes

    def _nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Nearest of the first n centres, in blocks of bounded size."""
        to = self.centres[:n]
        return np.concatenate([((to ** 2).sum(axis=1)[None, :] - 2 * (x[i:i + VECTOR_BLOCK] @ to.T)).argmin(axis=1)
                               for i in range(0, len(x), VECTOR_BLOCK)])

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell of each item (by the mean of its vectors); the centres nearest to its vectors, with the greatest distance."""
        for b in batches:
            x, sizes, starts = self._vectors(b)
            if not len(x):
                continue
            cell = self._nearest(np.add.reduceat(x, starts, axis=0) / sizes[:, None], self.cells)
            near, item = self._nearest(x, len(self.centres)), np.repeat(np.arange(len(sizes)), sizes)
            far = np.linalg.norm(x - self.centres[near], axis=1)
            order = np.lexsort((near, item))
            near, item, far = near[order], item[order], far[order]
            new = np.flatnonzero(np.r_[True, (near[1:] != near[:-1]) | (item[1:] != item[:-1])])
            offsets = pa.array(np.searchsorted(item[new], np.arange(len(sizes) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(near[new], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(np.maximum.reduceat(far, new)))],
                names=[*b.schema.names, "cell", "near", "far"])

    def bounds(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(query, cell): what an item of the cell scores at most.

        A vector at distance r from a centre has at most the token's product with the centre plus the token's length
        times r; a token counts its best of the cell's centres, a query the sum over its tokens."""
        norm, dots = np.linalg.norm(x, axis=1)[:, None], x @ self.centres.T
        out = np.full((len(starts), self.cells), -np.inf)
        for cell, (near, far) in self.reach.items():
            most = dots[:, near] + norm * (far + 1e-9 * (far + self.lengths[near]))[None, :]
            out[:, cell] = np.add.reduceat(most.max(axis=1), starts)
        return out

    def visit(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of each query: without a kth score the one of greatest bound; with one, all others whose bound reaches it."""
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_BLOCK):
                b = whole.slice(i, QUERY_BLOCK)
                x, _, starts = self._vectors(b)
                if not len(x):
                    continue
                bound = self.bounds(x, starts)
                home = bound.argmax(axis=1)
                first = b.column("kth").is_null().to_numpy(zero_copy_only=False)
                kth = b.column("kth").fill_null(0.0).to_numpy()
                go = (bound >= kth[:, None]) & ~first[:, None] & np.isin(np.arange(self.cells), list(self.reach))[None, :]
                go[np.arange(len(starts)), home] = first
                at, cell = np.nonzero(go)
                names = [n for n in b.schema.names if n != "kth"]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n).take(pa.array(at)) for n in names), pa.array(cell, pa.int64())], names=[*names, "cell"])


class SpaceShards:
    """Points (point_id, v, *on) dealt to shards by the nearest of a sample of at most MOST_CELLS vectors, large cells
    in parts; asked in two rounds.  A query first visits the cell of greatest bound, which gives it a kth score, and
    then the cells whose bound reaches that score: the others hold none of its best k.  `centres` (at least `cells`):
    the centres of the bounds; pages, whose patches lie in several places, need more of them than cells."""

    def __init__(self, points: DataFrame, cells: int, cosine: bool, on: Sequence[str], centres: int = 0):
        self.spark, self.cosine, self.on = points.sparkSession, cosine, list(on)
        one = F.get("v", F.pmod(F.xxhash64("point_id"), F.size("v")).cast("int"))
        some = points.orderBy(F.xxhash64("point_id")).limit(min(max(cells, centres), MOST_CELLS)).select(
            F.array(one).alias("v")).toArrow()
        sample = _matrices(some.column("v").combine_chunks())[0]
        sample = np.unique(_unit(sample) if cosine else sample, axis=0)
        sample = sample[np.random.default_rng(0).permutation(len(sample))]
        self.cells = _Cells(sample, min(cells, len(sample)), cosine)
        rows = points.select("point_id", self._owner().alias("owner"), "v")
        path = scratch_path(self.spark, "space-shards")
        rows.mapInArrow(self.cells.assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) +
                        ", cell long, near array<int>, far array<double>").write.parquet(path)
        self.points = self.spark.read.parquet(path)
        found = self.points.groupBy("cell").agg(
            F.sum(F.size("v").cast("long") * F.size(F.col("v")[0])).alias("values")).collect()
        parts = np.ones(self.cells.cells, dtype=np.int64)
        for r in found:
            parts[r["cell"]] = max(1, -(-r["values"] // SHARD_VALUES))
        # at most MOST_CELLS squared rows
        reach = self.points.select("cell", F.explode(F.arrays_zip("near", "far")).alias("z")).groupBy(
            "cell", F.col("z.near").alias("near")).agg(F.max("z.far").alias("far")).orderBy("cell").toArrow()
        cell, near, far = (reach.column(c).to_numpy() for c in ("cell", "near", "far"))
        cut = np.flatnonzero(np.diff(cell)) + 1
        self.cells.reach = {int(c[0]): (n, f) for c, n, f in zip(
            *(np.split(x, cut) for x in (cell, near, far)), strict=True) if len(c)}
        self.shards = int(parts.sum())
        at = lambda values: F.get(F.lit(values.tolist()), F.col("cell").cast("int"))
        self.first, self.parts = at(np.cumsum(parts) - parts), at(parts)

    def _owner(self) -> Column:
        return F.to_json(F.struct(*self.on), {"ignoreNullFields": "false"}) if self.on else F.lit("")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, owner, v, cell): the cells that queries (query_id, v, kth, *on) visit."""
        q = queries.select("query_id", self._owner().alias("owner"), "v", "kth")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema if f.name != "kth")
        return q.mapInArrow(self.cells.visit, kinds + ", cell long")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        points = self.points.select((self.first + F.pmod(F.xxhash64("point_id"), self.parts)).cast("int").alias("shard"),
                                    "owner", "point_id", "v")
        asked = asked.select(F.explode(F.sequence(self.first, self.first + self.parts - 1)).alias("shard"),
                             "owner", "query_id", "v")
        return _scored(points, asked, k, self.cosine, max(self.shards, 8) if self.on else self.shards)

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        home, asked = self.rounds(queries, k)
        return top_k(home.union(self.search(asked, k)), k)

    def rounds(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Answers of the first round, and the cells of the second."""
        path = scratch_path(self.spark, "home-answers")
        top_k(self.search(self.asked(queries.withColumn("kth", F.lit(None).cast("double"))), k), k).drop("rank").write.parquet(path)
        home = self.spark.read.parquet(path)
        kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        known = queries.join(kth, "query_id", "left").withColumn(
            "kth", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf"))).drop("n", "least")
        return home, self.asked(known)


def _nearby_top_k(points: DataFrame, queries: DataFrame, k: int, cosine: bool, on: Sequence[str],
                  centres: int = 0) -> DataFrame:
    """Like :func:`_blocked_top_k`, with shards by space; a single shard leaves nothing to choose."""
    some = (F.size("v") > 0) & (F.size(F.col("v")[0]) > 0)
    for c in on:  # null owners match nobody
        some = some & F.col(c).isNotNull()
    points, queries = points.where(some), queries.where(some)
    values = points.agg(F.sum(F.size("v").cast("long") * F.size(F.col("v")[0]))).first()[0] or 0
    cells = -(-values // SHARD_VALUES)
    if cells <= 1:
        return _blocked_top_k(points, queries, k, cosine, on)
    ship_package(points.sparkSession)
    return SpaceShards(points, cells, cosine, on, centres).top_k(queries, k)


# --------------------------------------------------------------------------
# Dense

def dense_topk(points: DataFrame, queries: DataFrame, k: int, *, point_id: str = "point_id",
               point_vec: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding",
               metric: str = "cosine", on: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Top-k points per query -> (query_id, rank, point_id, score, *on, *carry).

    metric: "cosine" (dot / (|a| |b|), 0 for a zero vector) or "dot".  `on`:
    owner columns present on both sides; a query only sees points with the
    same values (tenant filter before ranking, never after).  Point ids are
    unique; `on` and `carry` are joined to the winners."""
    p = points.select(F.col(point_id).alias("point_id"), F.array(F.col(point_vec)).alias("v"), *on).where(
        F.col("v")[0].isNotNull())
    q = queries.select(F.col(query_id).alias("query_id"), F.array(F.col(query_vec)).alias("v"), *on).where(
        F.col("v")[0].isNotNull())
    hits = _nearby_top_k(p, q, k, metric == "cosine", list(on))
    if on or carry:
        hits = hits.join(points.select(F.col(point_id).alias("point_id"), *on, *carry), "point_id")
    return hits.select("query_id", "rank", "point_id", "score", *on, *carry)


def rescore_topk(points: DataFrame, queries: DataFrame, k: int, *, point_id: str = "point_id",
                 point_vec: str = "embedding", query_id: str = "query_id",
                 query_vec: str = "embedding") -> DataFrame:
    """Exact top-k by dot product: a coarse pass over the quantised copy, then
    the full vectors of what may still be among the best k.

    The coarse pass knows each score up to the query's length times the point's
    error, so a point goes on if its upper bound reaches the kth lower bound of
    the query: the answers are those of the full vectors.  `points` may carry
    the stored columns of :func:`quantised`; otherwise they are computed."""
    stored = {"code", "scale", "error"} <= set(points.columns)
    coarse = points if stored else quantised(points, point_id, point_vec)
    p = coarse.select(F.col(point_id).alias("point_id"), "code", "scale", "error").where(F.col("code").isNotNull())
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("v")).where(
        F.size("v") > 0)
    left = candidates(p, q, k)
    full = points.select(F.col(point_id).alias("point_id"), F.col(point_vec).cast("array<double>").alias("x"))
    dot = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)
    scored = left.select("query_id", "point_id").join(full, "point_id").join(q, "query_id").select(
        "query_id", "point_id", dot.alias("score"))
    return top_k(scored, k).select("query_id", "rank", "point_id", "score")


def _quantise(point_id: str, vec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, scales, errors = [], [], []
            for x in b.column(vec):
                x = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                scale = float(np.abs(x).max(initial=0.0)) / 127 or 1.0
                code = np.rint(x / scale).astype(np.int8)
                codes.append(code.tobytes())
                scales.append(scale)
                errors.append(float(np.linalg.norm(x - scale * code)))
            yield pa.RecordBatch.from_arrays([b.column(point_id), pa.array(codes, pa.binary()), pa.array(scales, pa.float64()),
                                              pa.array(errors, pa.float64())], names=[point_id, "code", "scale", "error"])
    return run


def quantised(points: DataFrame, point_id: str = "point_id", point_vec: str = "embedding") -> DataFrame:
    """Point ids with the quantised copy of their vectors, to be stored: code (a signed byte a component), scale, and
    error, the distance of scale * code to the vector.  Null and empty vectors are left out."""
    ship_package(points.sparkSession)
    rows = points.select(point_id, point_vec).where(F.col(point_vec).isNotNull() & (F.size(point_vec) > 0))
    kind = rows.schema[point_id].dataType.simpleString()
    return rows.mapInArrow(_quantise(point_id, point_vec), f"`{point_id}` {kind}, code binary, scale double, error double")


class _CoarseShards:
    """Points of a shard that may be among a query's best k: (query_id, point_id, lower, upper).  Rows come sorted by
    shard, a shard's points before its queries."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, loaded = None, [], None
        for b in batches:
            marks = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "is_query")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if marks[lo][0] != shard:
                    shard, parts, loaded = marks[lo][0], [], None
                if not marks[lo][1]:
                    parts.append(part)
                elif parts:
                    loaded = loaded or self._load(parts)
                    for i in range(0, part.num_rows, QUERY_BLOCK):
                        yield self._bounds(loaded, part.slice(i, QUERY_BLOCK))

    def _load(self, parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts).combine_chunks()
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.int8).reshape(t.num_rows, -1)
        x = code.astype(np.float64) * t.column("scale").to_numpy()[:, None]
        return t.column("point_id"), x, t.column("error").to_numpy() + 1e-9 * np.linalg.norm(x, axis=1)

    def _bounds(self, loaded: tuple, queries: pa.RecordBatch) -> pa.RecordBatch:
        ids, x, error = loaded
        q = np.array([v.values.to_numpy(zero_copy_only=False) for v in queries.column("v")], dtype=np.float64)
        near, off = q @ x.T, np.linalg.norm(q, axis=1)[:, None] * error[None, :]
        lower, upper = near - off, near + off
        n = lower.shape[1]
        least = np.partition(lower, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(q), -np.inf)
        row, column = np.nonzero(upper >= least[:, None])
        return pa.RecordBatch.from_arrays(
            [queries.column("query_id").take(pa.array(row)), ids.take(pa.array(column)).combine_chunks(),
             pa.array(lower[row, column]), pa.array(upper[row, column])], names=["query_id", "point_id", "lower", "upper"])


def candidates(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, point_id, lower, upper) of the quantised points (point_id, code, scale, error) whose upper bound
    reaches the kth lower bound of the query (query_id, v)."""
    ship_package(points.sparkSession)
    values = points.agg(F.sum(F.length("code"))).first()[0] or 0
    shards = max(1, -(-values // SHARD_VALUES))
    qid, pid = queries.schema["query_id"].dataType, points.schema["point_id"].dataType
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = points.select(F.pmod(F.xxhash64("point_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("is_query"),
                         "point_id", nothing(qid).alias("query_id"), "code", "scale", "error", nothing("array<double>").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1))).alias("shard"), F.lit(1).alias("is_query"),
                           nothing(pid).alias("point_id"), "query_id", nothing("binary").alias("code"),
                           nothing("double").alias("scale"), nothing("double").alias("error"), "v")
    found = rows.union(asked).repartition(int(shards), "shard").sortWithinPartitions("shard", "is_query").mapInArrow(
        _CoarseShards(k), f"query_id {qid.simpleString()}, point_id {pid.simpleString()}, lower double, upper double")
    path = scratch_path(points.sparkSession, "coarse-answers")
    found.write.parquet(path)
    found = points.sparkSession.read.parquet(path)
    kth = top_k(found, k, score="lower").groupBy("query_id").agg(F.count("*").alias("n"), F.min("lower").alias("least"))
    return found.join(kth, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("least"))).select(
        "query_id", "point_id", "lower", "upper")


# --------------------------------------------------------------------------
# Late interaction

def _packed(df: DataFrame, key: Column, order: Column, vec: Column, on: Sequence[str], out: str) -> DataFrame:
    """One row per key with its vectors in order (a page's patches or a question's tokens: bounded by the encoder)."""
    g = df.select(key.alias(out), order.alias("n"), vec.alias("x"), *on).groupBy(out, *on).agg(
        F.sort_array(F.collect_list(F.struct("n", "x"))).alias("v"))
    return g.withColumn("v", F.transform("v", lambda s: s["x"]))


def maxsim_topk(patches: DataFrame, tokens: DataFrame, k: int, *, page_id: str = "page_key", patch_no: str = "patch_no",
                patch_vec: str = "embedding", query_id: str = "query_id", token_id: str = "token_no",
                token_vec: str = "embedding", normalize: bool = False, on: Sequence[str] = ()) -> DataFrame:
    """score(q, page) = sum over q's tokens of max over the page's patches of
    dot(token, patch); top-k pages per query -> (query_id, rank, page_id, score).

    normalize=True scales both sides to unit length first (cosine).  Patch
    rows are packed into pages first; store them packed (`pack_patches`) and
    use :func:`maxsim_topk_packed` to save that shuffle."""
    p = _packed(patches, F.col(page_id), F.col(patch_no), F.col(patch_vec), on, "point_id")
    t = _packed(tokens, F.col(query_id), F.col(token_id), F.col(token_vec), on, "query_id")
    return _nearby_top_k(p, t, k, normalize, list(on), PATCH_CENTRES).select(
        "query_id", "rank", F.col("point_id").alias(page_id), "score")


def pack_patches(patches: DataFrame, page_id: str = "page_key", patch_no: str = "patch_no",
                 vec: str = "embedding", out: str = "patches") -> DataFrame:
    """Exploded patch rows -> one row per page with its patch vectors in
    patch order (the multi-vector point layout)."""
    return _packed(patches, F.col(page_id), F.col(patch_no), F.col(vec), (), "point_id").select(
        F.col("point_id").alias(page_id), F.col("v").alias(out))


def maxsim_topk_packed(pages: DataFrame, tokens: DataFrame, k: int, *, page_id: str = "page_key",
                       patches: str = "patches", query_id: str = "query_id", token_id: str = "token_no",
                       token_vec: str = "embedding", normalize: bool = False) -> DataFrame:
    """Late interaction over packed pages."""
    p = pages.select(F.col(page_id).alias("point_id"), F.col(patches).alias("v"))
    t = _packed(tokens, F.col(query_id), F.col(token_id), F.col(token_vec), (), "query_id")
    return _nearby_top_k(p, t, k, normalize, [], PATCH_CENTRES).select(
        "query_id", "rank", F.col("point_id").alias(page_id), "score")


# --------------------------------------------------------------------------
# Context lists and projections

def context_lists(hits: DataFrame, query_id: str = "query_id", rank: str = "rank",
                  label: str = "label") -> DataFrame:
    """Per query the hit labels in rank order, as array and as the list text
    the run files store ("['a', 'b']").  Bounded by k per query."""
    g = hits.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct(F.col(rank), F.col(label)))).alias("_h"))
    labels = F.transform("_h", lambda x: x[label])
    text = F.concat(F.lit("["), F.array_join(F.transform(labels, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                    F.lit("]"))
    return g.select(query_id, labels.alias("labels"), text.alias("Context_papers"))


def project_context(hits: DataFrame, reference) -> DataFrame:
    """Hit -> context entry: (type, text, image_path, reference, score).

    image and pdf_page points are images; text and table points carry their
    content; anything else has no text."""
    t = F.col("type")
    return hits.select(
        "*",
        F.when(t.isin("image", "pdf_page"), "image").otherwise("text").alias("ctx_type"),
        F.when(t.isin("text", "table"), F.col("page_content")).otherwise(F.lit("")).alias("ctx_text"),
        F.col("img_link").alias("image_path"),
        reference.alias("reference"))
