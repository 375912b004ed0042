"""Operator 11: odd sketches and the near-duplicate components, against all pairs by brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtally.llm import minhash, oddsketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["node", "key", "n", "group", "digest", "bands", "sketch", "rid", "row_key", "comp", "component", "u", "v", "size", "at"]


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(4, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def by_hand(data):
    sets = [shingles(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = [find(i) for i in range(len(data))]
    least = {g: min((r[0] for r, h in zip(data, groups) if h == g and r[0] is not None), default=None) for g in groups}
    return Counter((r[0], len(s), least[g], r[0] is not None and r[0] == least[g]) for r, s, g in zip(data, sets, groups))


def fixture(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    out, i = [], 0
    for family in range(8):  # chains: each text changes a few words of one before it, so ends drift apart
        texts = [[word() for _ in range(rnd.randint(30, 120))]]
        for _ in range(12):
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(1, 3)):
                t[rnd.randrange(len(t))] = word()
            texts.append(t)
        for t in texts:
            out.append((i, (" " if i % 3 else "\n").join(t).swapcase() if i % 2 else " ".join(t), "en", "s", 1))
            i += 1
    out += [(i, None, None, None, None), (i + 1, "", "en", "s", 0), (i + 2, " \t\n", "en", "s", 3), (i + 3, "One", "en", "s", 3),
            (i + 4, "oNE", "en", "s", 3), (i + 5, "Été no two", "en", "s", 3), (i + 6, "été no two", "en", "s", 3),
            (i + 7, " ".join(word() for _ in range(25_000)), "en", "s", 3), (None, out[0][1], "en", "s", 3),
            (None, "alone " * 9, "en", "s", 3), (None, None, None, None, None)]
    out += [out[5], out[5], out[-4], (i + 9, out[-4][1] + " more", "en", "s", 3)]
    rnd.shuffle(out)
    return out


def test_components_are_those_of_all_pairs(spark):
    data = fixture(3)
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    got = minhash.components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == by_hand(data)


def test_only_texts_that_share_a_band_are_shuffled(spark, monkeypatch):
    """A table of mostly lone texts: the join that fetches texts gets those of the nodes in buckets and few others."""
    rnd = random.Random(6)
    lone = [(i, " ".join(f"w{rnd.randrange(10 ** 9)}" for _ in range(12)), "en", "s", 1) for i in range(600)]
    near = [(1000 + i, f"{lone[i][1]} {lone[i + 1][1]} end{j}", "en", "s", 1) for i in range(20) for j in range(2)]
    data = lone + near + near[:3] + [(None, near[5][1], "en", "s", 1)]
    kept, plans = [], {}
    likely, written = minhash._likely, minhash.written
    monkeypatch.setattr(minhash, "_likely", lambda *a: kept.append(likely(*a)) or kept[-1])
    monkeypatch.setattr(minhash, "written", lambda df, name: plans.setdefault(name, df) and written(df, name))
    got = minhash.components(spark.createDataFrame(data, SCHEMA))
    assert Counter(map(tuple, got.collect())) == by_hand(data)
    assert 40 <= kept[0].count() < 120
    plan = plans["minhash-sets"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
    assert "minhash-buckets" not in plans  # buckets and members come from one shuffle of the keys


def test_likely_keeps_every_wanted_row(spark):
    rows = spark.range(5000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("row_key"), "id")
    wanted = rows.where("id % 50 = 0").select("row_key")
    for slots, most in ((minhash._slots(100), 500), (64, 5000)):
        got = [r.id for r in minhash._likely(rows.union(rows), wanted, slots).collect()]
        assert Counter(i for i in got if i % 50 == 0) == Counter({i: 2 for i in range(0, 5000, 50)})
        assert len(set(got)) <= most
    assert minhash._likely(rows, wanted.limit(0), 64).count() == 0
    assert minhash._slots(0) == 1 << 12 and minhash._slots(1 << 40) == minhash.MOST_SLOTS


def test_blocks_and_groups_of_few_members_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP", 2)
    data = fixture(4)
    assert Counter(map(tuple, minhash.components(spark.createDataFrame(data, SCHEMA)).collect())) == by_hand(data)


def test_empty_table(spark):
    assert minhash.components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("similar", [0.8, 0.9, 0.97])
def test_sketches_estimate_the_similarity(similar):
    rng = np.random.default_rng(5)
    most, errors = oddsketch.most_bits(0.8), []
    for _ in range(60):
        both = round(2000 * similar)
        pool = rng.integers(0, 2 ** 63, 2000 + (2000 - both), dtype=np.uint64)
        a, b = pool[:2000], pool[2000 - both:]
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        count = int(np.bitwise_count(oddsketch.odd_sketch(oddsketch.samples(a)) ^ oddsketch.odd_sketch(oddsketch.samples(b))).sum())
        errors.append(oddsketch.estimate(count) - real)
        assert real < 0.8 or count <= most
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_equal_hashes_mean_equal_shingles():
    texts = ["a b c d", "a b cd", "ab c d e", "a b c", "b a c d", "a  b\tc\nd", "A B C D"]
    sets = [oddsketch.shingle_set(t).tolist() for t in texts]
    assert sets[0] == sets[5] == sets[6] and len({tuple(s) for s in sets}) == 5
