"""Exact top-k search by ball trees (operator 10).

Vectors are turned into integers (floor of SCALE * component) and dealt to
shards of about SHARD rows by a hash of the id.  Each task builds a ball tree
over its shard and answers blocks of queries by branch and bound: a node's
bound is the inner product with its centre plus the query's norm times its
radius, no more than its parent's; leaves are taken in order of the bound, and
a query stops when the bound falls below its current kth score.

Sharing the kth score: a query first visits its own shard; the kth score found
there goes with it to all other shards, so only rows that reach it come back.
The best k of each shard's answers are merged with a ranked window (each task
keeps k per query before the shuffle).

Queries are replicated once per shard, in blocks, as the task (a stated query
set against all rows) asks; the corpus is never replicated.

Defined results: null vectors and those with null or non-finite components
take no part, nor do rows with null id or with a component of 2^50 / SCALE or
more, which 64-bit scores can't hold; equal scores rank by smaller id; a row
is no candidate for a query of its own id; of repeated rows each is a candidate,
and a repeated query is asked once; vectors of another length than the query's
are no candidates; a query without candidates gives no row; very long vectors
are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

SCALE = 256
K = 5
SHARD = 4096
LEAF = 64
QUERY_BLOCK = 512
_NONE = np.iinfo(np.int64).max


def integer_vectors(table: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, v array<bigint>) of the rows that take part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0 ** 50 / scale))
    d = table.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & fine)
    return d.select("vec_id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


class BallTree:
    """Balls over integer points: centres, radii and bounds by level, points in leaf order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        by = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[by], points[by]
        self.most = float(np.abs(points).max(initial=0))
        self.leaves: list[np.ndarray] = []
        self.centre, self.radius, self.parent, self.leaf_of = [], [], [], []
        real = self.points.astype(np.float64)
        todo = [(np.arange(len(ids)), -1)]
        while todo:
            own, parent = todo.pop()
            x = real[own]
            c = x.mean(axis=0)
            node = len(self.parent)
            self.parent.append(parent)
            self.centre.append(c)
            self.radius.append(float(np.sqrt(((x - c) ** 2).sum(axis=1).max(initial=0.0))))
            if len(own) <= leaf or self.radius[-1] == 0:
                self.leaf_of.append(len(self.leaves))
                self.leaves.append(own)
                continue
            self.leaf_of.append(-1)
            axis = x[:, int(np.argmax(x.var(axis=0)))]
            halves = np.argsort(axis, kind="stable")
            mid = len(own) // 2
            todo += [(np.sort(own[halves[:mid]]), node), (np.sort(own[halves[mid:]]), node)]
        self.centre, self.radius = np.array(self.centre).reshape(len(self.parent), -1), np.array(self.radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of each query's inner products in each leaf."""
        x = q.astype(np.float64)
        norm = np.sqrt((x ** 2).sum(axis=1))[:, None]
        size = np.sqrt((self.centre ** 2).sum(axis=1))[None, :] + self.radius[None, :]
        b = x @ self.centre.T + norm * self.radius[None, :] + 1 + 1e-9 * norm * size
        for node, parent in enumerate(self.parent):  # parents come before their children
            if parent >= 0:
                b[:, node] = np.minimum(b[:, node], b[:, parent])
        at = np.array(self.leaf_of)
        out = np.empty((len(q), len(self.leaves)))
        out[:, at[at >= 0]] = b[:, at >= 0]
        return out

    def _scores(self, q: np.ndarray, points: np.ndarray) -> np.ndarray:
        if float(np.abs(q).max(initial=0)) * self.most * q.shape[1] < 2.0 ** 53:  # exact in doubles
            return (q.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
        return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in points] for x in q],
                        dtype=object).reshape(len(q), len(points)).astype(np.int64)

    def search(self, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Best k (scores, ids) of each query among rows that reach its kth score; missing ids are _NONE."""
        low = np.iinfo(np.int64).min
        best_s, best_i = np.full((len(q), k), low), np.full((len(q), k), _NONE)
        kth = kth.copy()
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(q))
        for step in range(len(self.leaves)):
            leaf = order[live, step]
            go = bound[live, leaf] >= kth[live]  # bounds fall along the order
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            for one in np.unique(leaf):
                who = live[leaf == one]
                own = self.leaves[one]
                s = self._scores(q[who], self.points[own])
                i = np.broadcast_to(self.ids[own], s.shape)
                s = np.where((i == ids[who, None]) | (s < kth[who, None]), low, s)
                some = (s > low).any(axis=1)
                who, s, i = who[some], s[some], i[some]
                if not len(who):
                    continue
                all_s, all_i = np.hstack((best_s[who], s)), np.hstack((best_i[who], np.where(s > low, i, _NONE)))
                first = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
                best_s[who], best_i[who] = np.take_along_axis(all_s, first, 1), np.take_along_axis(all_i, first, 1)
                full = best_i[who, -1] != _NONE
                kth[who[full]] = np.maximum(kth[who[full]], best_s[who[full], -1])
        return best_s, best_i


def _matrix(column: pa.Array) -> np.ndarray:
    rows = [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in column]
    return np.array(rows, dtype=np.int64).reshape(len(rows), -1)


class _Visit:
    """Answers of the shards of a partition to their queries.  Rows come sorted by shard and length, a shard's
    points before its queries; only one shard's points and one block of queries are held at a time."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, tree = None, [], None
        for b in batches:
            marks = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "dims", "query")])
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if (own := tuple(marks[lo][:2].tolist())) != key:
                    key, points, tree = own, [], None
                ids = part.column("id").to_numpy(zero_copy_only=False)
                if not marks[lo][2]:
                    points.append((ids, _matrix(part.column("v"))))
                    continue
                if not points:
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate([p[0] for p in points]), np.concatenate([p[1] for p in points]))
                kth, q = part.column("kth").to_numpy(zero_copy_only=False), _matrix(part.column("v"))
                for i in range(0, len(ids), QUERY_BLOCK):
                    at = slice(i, i + QUERY_BLOCK)
                    s, v = tree.search(ids[at], q[at], kth[at], self.k)
                    hit = v != _NONE
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[at], hit.sum(axis=1))), pa.array(v[hit]), pa.array(s[hit])],
                        names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; `vectors` as integer_vectors() gives them, `is_query` a condition on vec_id."""
    ship_package(vectors.sparkSession)
    d = written(vectors, "vectors")
    shards = max(1, -(-d.count() // SHARD))
    nothing = F.lit(int(np.iinfo(np.int64).min))
    d = d.withColumn("home", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    columns = ("shard", "dims", "query", "id", "v", "kth")
    points = d.select(F.col("home").alias("shard"), "dims", F.lit(0).alias("query"), F.col("vec_id").alias("id"), "v",
                      nothing.alias("kth"))
    queries = d.where(is_query).select(F.col("vec_id").alias("id"), "dims", "v", "home", F.lit(1).alias("query")).distinct()

    def visit(q: DataFrame) -> DataFrame:
        rows = points.union(q.select(*columns)).repartition(shards, "shard")
        return rows.sortWithinPartitions("shard", "dims", "query").mapInArrow(
            _Visit(k), "query_id long, vec_id long, score long")

    own = written(visit(queries.withColumns({"shard": F.col("home"), "kth": nothing})), "home-answers")
    reached = own.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    asked = queries.join(reached, queries["id"] == reached["query_id"], "left").withColumn(
        "kth", F.when(F.col("n") >= k, F.col("least")).otherwise(nothing))
    others = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return own.union(visit(others)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
