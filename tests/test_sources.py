"""Sources and sinks: alignment errors and defaults, config defaults, response import statuses."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtally.session import scratch_path
from ragtally.sources import csv_records as CR
from ragtally.sources import readers as RD
from ragtally.sources import sinks as SK


def test_align_links_counts_and_defaults(spark):
    files = spark.createDataFrame([("b.pdf",), ("a.pdf",), ("c.pdf",)], "name string")
    path = scratch_path(spark, "links")
    spark.createDataFrame([("  doi/1 ",), ("",), ("doi/2",), ("doi/3",)], "value string").coalesce(1).write.text(path)
    got = [(r.name, r.link) for r in RD.align_links(spark, files, path).collect()]
    assert got == [("a.pdf", "doi/1"), ("b.pdf", "doi/2"), ("c.pdf", "doi/3")]
    short = scratch_path(spark, "links2")
    spark.createDataFrame([("doi/1",)], "value string").coalesce(1).write.text(short)
    with pytest.raises(ValueError):
        RD.align_links(spark, files, short)
    few = [r.link for r in RD.align_links(spark, files, None, defaults=["x"]).collect()]
    assert few == ["", "", ""]
    many = [r.link for r in RD.align_links(spark, files, None, defaults=["x", "y", "z", "w"]).collect()]
    assert many == ["x", "y", "z"]


def test_scan_config_defaults(spark):
    cfg = RD.scan_config(spark, None).collect()
    assert [r.model_short for r in cfg] == ["gpt-4o", "gpt-4o-mini", "Gemma3-27b"]


def test_import_response_statuses(spark):
    reqs = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "custom_id string")
    path = scratch_path(spark, "resp")
    spark.createDataFrame([("r1", "B."), ("r2", None), ("r3", "[error] timeout"), ("r3", "A")],
                          "custom_id string, content string").write.json(path)
    out = {r.custom_id: (r.status, r.content, r.n_responses) for r in SK.import_responses(spark, reqs, path).collect()}
    assert out == {"r1": ("ok", "B.", 1), "r2": ("failed", None, 1), "r3": ("ok", "A", 2), "r4": ("missing", None, 0)}


def test_failed_requests_are_exported_again(spark):
    reqs = spark.createDataFrame([(i, f"ask {i}") for i in range(1, 6)], "id long, message string")
    answers, again = scratch_path(spark, "answers"), scratch_path(spark, "again")

    def answer(*rows):
        spark.createDataFrame(list(rows), "custom_id string, content string").write.mode("append").json(answers)

    def sent():
        SK.export_again(spark, reqs, answers, again, "id", "m")
        return sorted(int(r.custom_id) for r in spark.read.schema("custom_id string").json(again).collect())
    answer(("1", "B."), ("2", None), ("3", "[error] timeout"), ("3", "[error] timeout"))
    assert sent() == [2, 3, 4, 5]
    answer(("2", "A"), ("3", "[error] again"), ("4", "C"))
    assert sent() == [3, 5]
    answer(("3", "D"), ("5", ""))
    assert sent() == []


def test_scan_corpus_suffix_any_case(spark):
    d = scratch_path(spark, "corpus")
    import os
    os.makedirs(d)
    for n in ("b.PDF", "a.pdf", "c.txt"):
        with open(os.path.join(d, n), "wb") as fh:
            fh.write(b"x")
    names = [r.name for r in RD.scan_corpus(spark, d, ".pdf").collect()]
    assert names == ["a.pdf", "b.PDF"]


def test_cache_computes_each_missing_content_once(spark, tmp_path):
    seen = []

    def lengths(missing):
        seen.append(sorted(("" if r.text is None else r.text) for r in missing.collect()))
        return missing.select("key", F.length("text").alias("size"))

    rows = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    fill = lambda df: SK.fill_cache(spark, str(tmp_path), "a/b", df, "text", lengths)
    with pytest.raises(ValueError):
        SK.cached_vectors(spark, str(tmp_path), "a/b", rows("x"), "text")
    assert fill(rows("one", "three", "one", None, "")) == 4 and seen[-1] == ["", "", "one", "three"]
    assert fill(rows("one", "three")) == 0 and fill(rows()) == 0
    assert fill(rows("three", "seven!!", "one", "seven!!")) == 1 and seen[-1] == ["seven!!"]
    # a fill that was cut off: no _SUCCESS
    spark.createDataFrame([("k", 1)], "key string, size int").write.parquet(f"{tmp_path}/a__b/_fill=x")
    (tmp_path / "a__b" / "_fill=x" / "_SUCCESS").unlink()
    got = SK.cached_vectors(spark, str(tmp_path), "a/b", rows("seven!!", None, "", "one", "unknown", "one"), "text")
    assert sorted(tuple(r) for r in got.select("id", "size").fillna(-1).collect()) == [
        (0, 7), (1, -1), (2, 0), (3, 3), (4, -1), (5, 3)]
    assert got.columns == ["id", "text", "size"]


CSV_KIND = "id long, text string, note string"


def write_csv(path, rows, end="\n"):
    """RFC 4180: every text quoted, quotes doubled; empty note unquoted."""
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    with open(path, "w", newline="") as fh:
        fh.write(f"id,text,note{end}")
        for i, text, note in rows:
            fh.write(f"{i},{quoted(text)},{'' if note is None else quoted(note)}{end}")


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_splits_reads_what_was_written(spark, tmp_path, small_splits, end):
    import random
    rng = random.Random(3)
    signs = ['"', "\n", ",", "a", "b c", '""', "\n\n", "é", "line\n1,\"x\",y\n"]
    texts = lambda: "x" + "".join(rng.choice(signs) for _ in range(rng.randrange(12))) + "y"
    want = {}
    for name, n in (("a.csv", 1500), ("b.csv", 1), ("c.csv", 0), ("d.csv", 300)):
        rows = [(i, texts(), rng.choice([None, "n", "two\nlines"])) for i in range(n)]
        rows += [(n, "long " + "word \n" * 4000 + "end", None)] if n == 300 else []  # a record over several splits
        write_csv(tmp_path / name, rows, end)
        want[name] = rows
    kind = T._parse_datatype_string(CSV_KIND)
    got = CR.scan_csv(spark, str(tmp_path), kind, RD.CSV_OPTIONS)
    assert CR.csv_records(spark, str(tmp_path)).where("block > 0").count() > 100  # read in many splits
    rows = got.orderBy("file_path", "block", "line").collect()
    for name, expected in want.items():
        assert [(r.id, r.text, r.note) for r in rows if r.file_path.endswith(name)] == expected
    plain = spark.read.options(**RD.CSV_OPTIONS).schema(CSV_KIND).csv(str(tmp_path))
    if end == "\n":
        assert sorted(map(tuple, plain.select("id", "text").collect())) == sorted((r.id, r.text) for r in rows)


def test_csv_edge_cases(spark, tmp_path):
    (tmp_path / "e.csv").write_text('id,"te\nxt",note\n\n7,,""\nbad,"q"\n\n8,plain,last')  # header of two lines, no end
    (tmp_path / "f.csv").write_text("")
    got = CR.scan_csv(spark, str(tmp_path), T._parse_datatype_string(CSV_KIND), RD.CSV_OPTIONS).orderBy("line").collect()
    assert [(r.id, r.text, r.note) for r in got] == [(7, None, None), (None, "q", None), (8, "plain", "last")]
    plain = spark.read.options(**RD.CSV_OPTIONS).schema(CSV_KIND).csv(str(tmp_path)).collect()
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in plain]


def test_merge_runs_numbers_files_read_in_splits(spark, tmp_path, small_splits):
    for run, (model, n) in enumerate([("m1", 900), ("m2", 5), ("m1", 3)]):
        (tmp_path / f"run{run}").mkdir()
        write_csv(tmp_path / f"run{run}" / "part.csv", [(i, model, "r\n1") for i in range(n)])
    got = RD.merge_runs(spark, str(tmp_path), "id long, Model string, Model_ret string").groupBy("Model", "Iteration").count()
    assert sorted(map(tuple, got.collect())) == [("m1", 1, 900), ("m1", 2, 3), ("m2", 1, 5)]
