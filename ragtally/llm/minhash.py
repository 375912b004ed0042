"""MinHash near-duplicates with odd sketches (operator 11).

Documents are linked if the sets of their word shingles have a similarity (intersection by union) of LEAST per
cent or more.  Sets, MinHash samples, band keys and odd sketches: :mod:`ragtally.llm.oddsketch`.

1. Documents of one set are one node (the digest of the set), so copies cost a row each.
2. Nodes that share a band key form a bucket; each member is a candidate with the bucket's least node.
3. A candidate whose sizes allow the similarity, and whose sketches are near enough, is confirmed on the full sets;
   the confirmed links give components.
4. Only buckets whose members are still in several components are looked at again, pairs of blocks of BLOCK members
   at a time: sketches of different components are compared by exclusive-or and population count.  So a large group
   of near copies, once connected, is not compared pair by pair.
5. What passes is confirmed on the full sets as well; all links give the components.

Only the texts of nodes in a bucket are fetched again for their sets; a bitmap of their keys keeps most others out of
the shuffle, the join after it decides.

A confirmation task holds the sets of two groups of GROUP nodes; nodes that share a bucket have neighbouring numbers,
so a set is sent to few tasks.  A task returns a spanning forest of its links.

A link is lost only by chance: no common band (below 1e-7 at the least similarity, far less above it) or sketches
that refuse the pair (`oddsketch.REFUSED`).  Nothing is capped.

Defined results: null and empty texts, and texts without words, have an empty set and are their own component; a
null doc_id takes the component of its group (null only if no member has an id) and is never kept; repeated rows
give repeated rows; very long texts are processed whole; an empty table gives an empty result; columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import oddsketch
from .common import MOST_SLOTS, numbered, smallest_reachable, text_of, written  # noqa: F401
from .common import likely as _likely
from .common import slots as _slots

LEAST = 80  # per cent
BLOCK = 512
GROUP = 256

_PRINT = "doc_id long, n_shingles long, digest binary, bands array<bigint>, sketch binary"


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests, bands, sketches = [], [], [], []
        for text in b.column("text").to_pylist():
            hashes = oddsketch.shingle_set(text)
            sizes.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            if len(hashes):
                least = oddsketch.samples(hashes)
                bands.append(oddsketch.band_keys(least).view(np.int64))
                sketches.append(oddsketch.odd_sketch(least).tobytes())
            else:
                bands.append(None)
                sketches.append(None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "bands", "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [oddsketch.shingle_set(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("group"), pa.array(sets, pa.binary())],
                                         names=["node", "group", "hashes"])


def _find(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _confirm(u: np.ndarray, v: np.ndarray, sets: dict[int, set], least: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that are linked."""
    parent: dict[int, int] = {}
    forest = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = _find(parent, a), _find(parent, b)
        if x == y:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
            parent[x] = y
            forest.append((a, b))
    return forest


def _edges(forest: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([y for _, y in forest], pa.int64())})


def _confirm_groups(least: int):
    """The sets that a pair of groups needs (one row a side) and its candidates (rows of nodes u and v)."""
    def run(t: pa.Table) -> pa.Table:
        sets, us, vs = {}, [], []
        for nodes, hashes, u, v in zip(*[t.column(n) for n in ("nodes", "sets", "u", "v")], strict=True):
            if u.is_valid:
                us.append(u.values.to_numpy())
                vs.append(v.values.to_numpy())
                continue
            for node, h in zip(nodes.as_py(), hashes.as_py(), strict=True):
                sets[node] = set(np.frombuffer(h, np.uint64).tolist())
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
        return _edges(_confirm(pairs[:, 0], pairs[:, 1], sets, least))
    return run


def confirmed(candidates: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """Links (a, b) among candidates (gu, gv, u array, v array), u and v nodes of the groups gu and gv; `sets` has
    (group, list of node and hashes).  A pair of groups gets the sets it needs, one row a side.  Of the links between
    two groups a spanning forest is returned."""
    side = lambda group, wanted: F.struct(F.col(group).alias("group"), F.array_distinct(wanted).alias("wanted"))
    sides = candidates.select("gu", "gv", F.explode(F.array(side("gu", F.col("u")), side("gv", F.col("v")))).alias("s"))
    found = sides.select("gu", "gv", "s.*").join(sets, "group").select(
        "gu", "gv", F.filter("list", lambda x: F.array_contains(F.col("wanted"), x["node"])).alias("list"))
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = found.select("gu", "gv", F.col("list.node").alias("nodes"), F.col("list.hashes").alias("sets"),
                        nothing("array<bigint>").alias("u"), nothing("array<bigint>").alias("v"))
    rows = rows.union(candidates.select("gu", "gv", nothing("array<bigint>"), nothing("array<binary>"), "u", "v"))
    return rows.groupBy("gu", "gv").applyInArrow(_confirm_groups(least), "a long, b long")


def _sizes_allow(a: Column, b: Column, least: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * least


def _tile_batches(least: int, most: int):
    """Pairs of blocks: candidates of different components, by pair of groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(x) -> tuple:
            f = x.values.flatten()
            raw = b"".join(f[4].to_pylist())
            return tuple(np.asarray(f[i].to_numpy(zero_copy_only=False), dtype=np.int64) for i in range(4)) + (
                np.frombuffer(raw, np.uint64).reshape(-1, oddsketch.BITS // 64),)

        for batch in batches:
            for i, j, left, right in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(),
                                         batch.column("left"), batch.column("right"), strict=True):
                comp, node, size, group, sketch = block(left)
                comp2, node2, size2, group2, sketch2 = block(right)
                us, vs, gus, gvs = [], [], [], []
                for r in range(len(node)):
                    apart = np.bitwise_count(sketch2 ^ sketch[r]).sum(axis=1, dtype=np.int64)
                    ok = (apart <= most) & (comp2 != comp[r]) & (
                        np.minimum(size2, size[r]) * 100 >= np.maximum(size2, size[r]) * least)
                    if i == j:
                        ok[:r + 1] = False
                    c = np.flatnonzero(ok)
                    us.append(np.full(len(c), node[r]))
                    gus.append(np.full(len(c), group[r]))
                    vs.append(node2[c])
                    gvs.append(group2[c])
                u, v, gu, gv = (np.concatenate(x) for x in (us, vs, gus, gvs))
                if not len(u):
                    continue
                swap = (gu > gv) | ((gu == gv) & (u > v))
                u, v, gu, gv = (np.where(swap, v, u), np.where(swap, u, v), np.where(swap, gv, gu), np.where(swap, gu, gv))
                order = np.lexsort((gv, gu))
                u, v, gu, gv = u[order], v[order], gu[order], gv[order]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(gu) != 0) | (np.diff(gv) != 0))))
                cuts = pa.array(np.append(new, len(u)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gu[new]), pa.array(gv[new]), pa.ListArray.from_arrays(cuts, pa.array(u)),
                     pa.ListArray.from_arrays(cuts, pa.array(v))], names=["gu", "gv", "u", "v"])
    return run


def _parts(rows: int) -> int:
    """Tasks for so many block pairs: a few to a task, so an Arrow batch of them stays small."""
    return max(1, min(20_000, rows // 16 + 1))


def links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """Edges between nodes whose components are those of all links between different sets."""
    # one shuffle by key for the buckets and for their members
    places = nodes.select("node", F.explode("bands").alias("key")).repartition("key")
    often = places.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("rep")).where("n > 1")
    members = written(places.join(often, "key").select("key", "n", "rep", "node"), "minhash-members")
    family = members.groupBy("node").agg(F.min("rep").alias("family"))
    groups = numbered(family, [F.col("family"), F.col("node")], "at").select("node", F.floor(F.col("at") / GROUP).alias("group"))
    own = prints.select(F.col("rid").alias("node"), "n_shingles", "sketch", "row_key")
    info = written(groups.join(own, "node"), "minhash-info")
    wanted = info.select("row_key", "node", "group")
    texts = _likely(_keyed(docs).select("row_key", "text"), wanted, _slots(wanted.count()))
    texts = texts.dropDuplicates(["row_key"]).join(wanted, "row_key").select("node", "group", "text")
    sets = texts.mapInArrow(_set_batches, "node long, group long, hashes binary")
    sets = written(sets.groupBy("group").agg(F.collect_list(F.struct("node", "hashes")).alias("list")), "minhash-sets")
    most = oddsketch.most_bits(least / 100)

    def side(name: str) -> DataFrame:
        return info.select(F.col("node").alias(name), F.col("group").alias(f"g{name}"), F.col("n_shingles").alias(f"n{name}"),
                           F.col("sketch").alias(f"s{name}"))

    # candidates with the least node of a bucket
    star = written(members.where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v")).distinct(), "minhash-star")
    star = star.join(side("u"), "u").join(side("v"), "v").where(_sizes_allow(F.col("nu"), F.col("nv"), least))
    star = star.mapInArrow(_near_batches(most), "u long, v long, gu long, gv long")
    packed = written(star.groupBy("gu", "gv").agg(F.collect_list("u").alias("u"), F.collect_list("v").alias("v")), "minhash-candidates")
    first = written(confirmed(packed, sets, least), "minhash-links")

    # buckets still in several components
    found = smallest_reachable(first)
    now = members.where("n > 2").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    now = written(now, "minhash-components")
    split = written(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "minhash-split")
    order = numbered(now.join(split, "key"), [F.col("key"), F.col("comp"), F.col("node")], "at")
    order = written(order, "minhash-order")
    start = order.groupBy("key").agg(F.min("at").alias("start"))
    blocks = (order.join(start, "key").join(info, "node")
              .groupBy("key", F.floor((F.col("at") - F.col("start")) / BLOCK).alias("block"))
              .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                   F.collect_list(F.struct("comp", "node", F.col("n_shingles").alias("size"), "group", "sketch")).alias("list")))
    blocks = written(blocks, "minhash-blocks")
    a = blocks.select("key", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    b = blocks.select("key", F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    pairs = written(a.join(b, "key").where("i <= j and not (lo_i = hi_i and lo_j = hi_j and lo_i = lo_j)").select("key", "i", "j"),
                    "minhash-tiles")
    pairs = pairs.join(blocks.select("key", F.col("block").alias("i"), F.col("list").alias("left")), ["key", "i"]).join(
        blocks.select("key", F.col("block").alias("j"), F.col("list").alias("right")), ["key", "j"])
    tiles = pairs.repartition(_parts(blocks.count()), "key", "i", "j").mapInArrow(
        _tile_batches(least, most), "gu long, gv long, u array<bigint>, v array<bigint>")
    return first.union(confirmed(written(tiles, "minhash-candidates"), sets, least))


def _near_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = [np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint64).reshape(b.num_rows, -1) for n in ("su", "sv")]
            near = np.bitwise_count(words[0] ^ words[1]).sum(axis=1, dtype=np.int64) <= most
            u, v, gu, gv = (b.column(n).to_numpy()[near] for n in ("u", "v", "gu", "gv"))
            swap = gu > gv
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(swap, v, u)), pa.array(np.where(swap, u, v)), pa.array(np.where(swap, gv, gu)),
                 pa.array(np.where(swap, gu, gv))], names=["u", "v", "gu", "gv"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of())))
    return docs.select("doc_id", key.alias("row_key"), text_of().alias("text"))


def components(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept, for every row."""
    ship_package(docs.sparkSession)
    prints = _keyed(docs).mapInArrow(_keyed_prints, _PRINT + ", row_key binary")
    # the number is only used once it is in the written table
    prints = written(prints.withColumn("rid", F.monotonically_increasing_id()), "minhash-prints")
    groups = written(prints.where("n_shingles > 0").groupBy("digest").agg(
        F.min("rid").alias("node"), F.min("doc_id").alias("least")), "minhash-groups")
    nodes = prints.select(F.col("rid").alias("node"), "n_shingles", "bands", "sketch").join(groups.select("node", "least"), "node")
    edges = written(links(docs, prints, nodes, least), "minhash-links")
    found = smallest_reachable(edges)
    own = groups.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    own = written(own, "minhash-nodes")
    ids = own.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(own.join(ids, "component").select("digest", "component_id"), "minhash-ids")
    rows = prints.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    rows = rows.where("digest is not null").join(of, "digest").select("doc_id", "n_shingles", "component_id").union(
        rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _keyed_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in _print_batches([b]):
            yield p.append_column("row_key", b.column("row_key"))
