"""Shards by space and the quantised coarse pass: the answers of brute force for less work."""

import numpy as np
import pytest

from ragtally.operators import retrieval as RT

DIM = 768


def clustered(seed, n, groups, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, DIM)) * scale
    return centres[np.arange(n) % groups] + rng.normal(size=(n, DIM)) * 0.15 * scale


def frames(spark, points, queries):
    p = spark.createDataFrame([(i, v.tolist(), f"o{i % 2}") for i, v in enumerate(points)], "point_id long, embedding array<double>, owner string")
    q = spark.createDataFrame([(i, v.tolist(), f"o{i % 2}") for i, v in enumerate(queries)], "query_id long, embedding array<double>, owner string")
    return p.repartition(4), q


def best(points, queries, k, metric, owner=False):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit(queries) @ unit(points).T if metric == "cosine" else queries @ points.T
    if owner:
        s = np.where((np.arange(len(points))[None, :] % 2) == (np.arange(len(queries))[:, None] % 2), s, -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(i, r + 1): (int(c), round(float(s[i, c]), 6)) for i, row in enumerate(order) for r, c in enumerate(row)}


def found(df):
    return {(r.query_id, r.rank): (r.point_id, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("metric,on", [("cosine", []), ("dot", []), ("cosine", ["owner"])])
def test_shards_by_space_give_the_same(spark, monkeypatch, metric, on):
    monkeypatch.setattr(RT, "SHARD_VALUES", 40 * DIM)
    points, queries = clustered(1, 600, 15), clustered(1, 30, 15) + 0.01
    p, q = frames(spark, points, queries)
    assert found(RT.dense_topk(p, q, 5, metric=metric, on=on)) == best(points, queries, 5, metric, bool(on))


def test_few_shards_are_visited(spark, monkeypatch, capsys):
    monkeypatch.setattr(RT, "SHARD_VALUES", 20 * DIM)
    points, queries = clustered(2, 1000, 10), clustered(2, 40, 10) + 0.01
    p, q = frames(spark, points, queries)
    as_v = "array(embedding) as v"
    shards = RT.SpaceShards(p.selectExpr("point_id", as_v), 50, True, [])
    home, asked = shards.rounds(q.selectExpr("query_id", as_v), 5)
    cells, visits = len(shards.cells.centres), asked.count()
    with capsys.disabled():
        print(f"\n{visits / 40 + 1:.1f} of {cells} cells a query at {DIM} dimensions")
    assert visits + 40 < 0.5 * 40 * cells


def test_shards_of_copies_and_of_fewer_points_than_k(spark, monkeypatch):
    monkeypatch.setattr(RT, "SHARD_VALUES", 2 * DIM)
    points = np.repeat(clustered(3, 4, 2), 3, axis=0)  # all in few places; zero vectors too
    points[0] = 0
    queries = np.concatenate((points[:3], np.zeros((1, DIM))))
    p, q = frames(spark, points, queries)
    got = found(RT.dense_topk(p, q, 20, metric="dot"))
    want = best(points, queries, 20, "dot")
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}) and len(got) == 4 * 12
    empty = p.where("false")
    assert RT.dense_topk(empty, q, 3).count() == 0 and RT.dense_topk(p, q.where("false"), 3).count() == 0


@pytest.mark.parametrize("scale", [0.01, 1.0, 50.0])
def test_rescoring_gives_the_answers_of_full_vectors(spark, monkeypatch, scale):
    monkeypatch.setattr(RT, "SHARD_VALUES", 300 * DIM)
    points, queries = clustered(4, 1000, 20, scale), clustered(4, 20, 20, scale)
    p, q = frames(spark, points, queries)
    want = best(points, queries, 5, "dot")
    got = found(RT.rescore_topk(p, q, 5))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [got[k][1] for k in sorted(got)] == pytest.approx([want[k][1] for k in sorted(want)])
    stored = p.join(RT.quantised(p), "point_id")
    assert found(RT.rescore_topk(stored, q, 5)) == got
    left = RT.candidates(RT.quantised(p), q.selectExpr("query_id", "embedding as v"), 5).count()
    assert 20 * 5 <= left < 0.05 * 20 * len(points)


def test_rescoring_edge_cases(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, -300.0]), (5, [1.0, -300.0])],
                              "point_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    got = found(RT.rescore_topk(p, q, 2))
    assert got == {(1, 1): (4, 1.0), (1, 2): (5, 1.0), (2, 1): (1, 0.0), (2, 2): (4, 0.0)}
    assert RT.rescore_topk(p.where("false"), q, 2).count() == 0


def pages_of(seed, n, groups, patches, spread=0.15):
    """Pages whose patches lie around the places of their group; every fifth page mixes two groups."""
    rng = np.random.default_rng(seed)
    places = rng.normal(size=(groups, patches, 64))
    home = np.arange(n) % groups
    out = places[home] + rng.normal(size=(n, patches, 64)) * spread
    out[::5, : patches // 2] = places[(home[::5] + 1) % groups, : patches // 2]
    return out


def page_frames(spark, pages, questions):
    rows = lambda items: [(i, j, v.tolist(), f"o{i % 2}") for i, p in enumerate(items) for j, v in enumerate(p)]
    patches = spark.createDataFrame(rows(pages), "page_key long, patch_no int, embedding array<double>, owner string")
    tokens = spark.createDataFrame(rows(questions), "query_id long, token_no int, embedding array<double>, owner string")
    return patches.repartition(4), tokens


def best_pages(pages, questions, k, cosine, owner=False):
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True) if cosine else x
    out = {}
    for i, q in enumerate(questions):
        s = [(-(unit(q) @ unit(p).T).max(axis=1).sum(), j) for j, p in enumerate(pages) if not owner or i % 2 == j % 2]
        out |= {(i, r + 1): (j, round(float(-x), 6)) for r, (x, j) in enumerate(sorted(s)[:k])}
    return out


@pytest.mark.parametrize("cosine,on", [(False, []), (True, []), (True, ["owner"])])
def test_late_interaction_on_shards_by_space(spark, monkeypatch, cosine, on):
    monkeypatch.setattr(RT, "SHARD_VALUES", 12 * 6 * 64)
    pages, questions = pages_of(5, 300, 12, 6), pages_of(5, 12, 12, 6)[:, :4] + 0.01
    p, t = page_frames(spark, pages, questions)
    got = RT.maxsim_topk(p, t, 5, normalize=cosine, on=on)
    assert {(r.query_id, r.rank): (r.page_key, round(r.score, 6)) for r in got.collect()} == best_pages(
        pages, questions, 5, cosine, bool(on))


def test_late_interaction_without_places_is_exact_too(spark, monkeypatch):
    monkeypatch.setattr(RT, "SHARD_VALUES", 500)
    rng = np.random.default_rng(6)
    pages = [rng.normal(size=(1 + i % 4, 64)) for i in range(60)]  # pages of unlike size, no groups at all
    questions = [rng.normal(size=(1 + i % 3, 64)) for i in range(5)]
    p, t = page_frames(spark, pages, questions)
    got = RT.maxsim_topk(p, t, 70)  # more than there are pages
    assert {(r.query_id, r.rank): (r.page_key, round(r.score, 6)) for r in got.collect()} == best_pages(pages, questions, 70, False)
    packed = RT.maxsim_topk_packed(RT.pack_patches(p), t, 3)
    assert {(r.query_id, r.rank): r.page_key for r in packed.collect()} == {
        key: v[0] for key, v in best_pages(pages, questions, 3, False).items()}


def test_late_interaction_visits_few_shards(spark, monkeypatch, capsys):
    pages, questions = pages_of(7, 400, 20, 6, 0.05), pages_of(7, 20, 20, 6, 0.05)[:, :4]
    p, t = page_frames(spark, pages, questions)
    monkeypatch.setattr(RT, "SHARD_VALUES", 10 * 6 * 64)
    packed = RT.pack_patches(p).selectExpr("page_key as point_id", "patches as v")
    asked = t.groupBy("query_id").agg({"embedding": "collect_list"}).toDF("query_id", "v")
    shards = RT.SpaceShards(packed, 40, True, [], 256)
    visits = shards.rounds(asked, 5)[1].count()
    with capsys.disabled():
        print(f"\n{visits / 20 + 1:.1f} of {shards.cells.cells} cells of pages a question")
    assert visits + 20 < 0.5 * 20 * shards.cells.cells
