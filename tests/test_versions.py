"""Collections in buckets with versions: upserts, deletes, replays, removal."""

import glob
import os
import random
import tempfile

import pytest

from ragtally.streaming import versions as VE

SCHEMA = "id long, v string, version int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_random_changes_equal_a_dictionary(spark):
    root, rnd, want = tempfile.mkdtemp(prefix="ragtally-versions-"), random.Random(5), {}
    for step in range(7):
        if step % 3 == 2:
            least = rnd.randint(0, 12)
            n = VE.delete(spark, root, "id", f"version >= {least} and id % 2 = 0")
            gone = [i for i, r in want.items() if i is not None and i % 2 == 0 and r[1] is not None and r[1] >= least]
            assert n == len(gone)
            for i in gone:
                del want[i]
        else:
            new = {i: (f"{step}-{i}", rnd.choice([None, *range(20)])) for i in rnd.sample([None, *range(60)], 25)}
            VE.upsert(spark, root, table(spark, [(i, *r) for i, r in new.items()]), "id", "version", buckets=8)
            for i, r in new.items():
                rank = lambda x: -1 if x[1] is None else x[1]
                if i not in want or rank(r) >= rank(want[i]):
                    want[i] = r
        got = rows_of(VE.read(spark, root, "id", ["id", "v", "version"]))
        assert got == sorted(((i, *r) for i, r in want.items()), key=str)


def test_a_batch_rewrites_its_buckets_only(spark):
    root = tempfile.mkdtemp(prefix="ragtally-versions-")
    VE.upsert(spark, root, table(spark, [(i, "x" * 50, 1) for i in range(5000)]), "id", "version", buckets=64)
    size = lambda n: sum(os.path.getsize(f) for f in glob.glob(f"{root}/state/_v={n}/**/*.parquet", recursive=True))
    touched = VE.upsert(spark, root, table(spark, [(7, "new", 2)]), "id", "version")
    assert len(touched) == 1 and size(1) * 30 < size(0)
    assert VE.delete(spark, root, "id", "id = 8") == 1 and not os.path.exists(f"{root}/state/_v=2")
    got = {r.id: r.v for r in VE.read(spark, root, "id", ["id", "v"]).collect()}
    assert len(got) == 4999 and got[7] == "new" and 8 not in got
    before = VE.read(spark, root, "id", ["id", "v"], version=1)
    assert before.count() == 5000  # an older version stays readable


def test_batches_count_once_and_cut_off_writes_leave_nothing(spark):
    root = tempfile.mkdtemp(prefix="ragtally-versions-")
    put = lambda rows, batch: VE.upsert(spark, root, table(spark, rows), "id", "version", 4, batch)
    put([(1, "a", 1), (2, "b", 1)], 0)
    VE.delete(spark, root, "id", "id = 2")
    assert put([(2, "again", 9)], 0) == []  # a replay
    # a version that was cut off before its manifest
    table(spark, [(9, "half", 1)]).write.parquet(f"{root}/state/_v=2/_bucket=0")
    assert rows_of(VE.read(spark, root, "id", ["id", "v"])) == [(1, "a")]
    put([(2, "back", 1)], 1)  # a deleted id comes back
    assert rows_of(VE.read(spark, root, "id", ["id", "v"])) == [(1, "a"), (2, "back")]


def test_old_versions_go(spark):
    root = tempfile.mkdtemp(prefix="ragtally-versions-")
    for i in range(6):
        VE.upsert(spark, root, table(spark, [(1, f"v{i}", i), (100 + i, "x", 1)]), "id", "version", 4)
    VE.delete(spark, root, "id", "id = 100")
    VE.remove_old(spark, root, keep=2)
    assert VE.complete(spark, f"{root}/manifest") == [5, 6]
    want = [(1, "v5"), *[(100 + i, "x") for i in range(1, 6)]]
    assert rows_of(VE.read(spark, root, "id", ["id", "v"])) == want
    assert rows_of(VE.read(spark, root, "id", ["id", "v"], version=5)) == sorted(want + [(100, "x")])
    live = {(e.version, e.bucket) for n in (5, 6) for e in VE.manifest(spark, root, n)}
    files = {tuple(int(x.split("=")[1]) for x in f.split("/")[-3:-1]) for f in glob.glob(f"{root}/state/*/*/*.parquet")}
    assert files == live


def test_empty_writes(spark):
    root = tempfile.mkdtemp(prefix="ragtally-versions-")
    assert VE.upsert(spark, root, table(spark, []), "id", "version") == [] and VE.delete(spark, root, "id", "true") == 0
    with pytest.raises(ValueError):
        VE.read(spark, root, "id", ["id"])
