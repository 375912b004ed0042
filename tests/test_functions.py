"""Golden cases and properties of the Column functions."""

import math

import pytest
from pyspark.sql import functions as F

from ragtally.functions import answers as A
from ragtally.functions import metrics as M
from ragtally.functions import stats as S
from ragtally.functions import text as TX


@pytest.mark.parametrize("raw,expected", [
    ("A", "A"), ("b", ""), ("B.", "B"), ("The answer is C", "A"), ("Answer: C", ""), ("Answer: C.", "C"),
    ('{"answer":"B"}', "B"), ("Because", "B"), (None, ""), ("  d ) ", "D"), ("x:\n\n  C  is right", "C"),
])
def test_parse_answer_golden(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(A.parse_answer("r")).first()[0] == expected


def test_unpermute_inverts_permute(spark):
    df = spark.range(50).withColumnRenamed("id", "q").withColumn("perm", A.permutation("q", 42))
    rows = df.select("q", "perm").collect()
    for r in rows:
        assert sorted(r.perm) == [0, 1, 2, 3]
    # showing option perm[j] under letter j, then un-permuting letter j gives option perm[j]
    ex = df.select("q", "perm", F.explode(F.array(*[F.lit(c) for c in "ABCD"])).alias("shown"))
    out = ex.select("perm", "shown", A.unpermute_answer("shown", "perm").alias("orig")).collect()
    for r in out:
        assert r.orig == "ABCD"[r.perm["ABCD".index(r.shown)]]
    assert spark.createDataFrame([("",)], "l string").withColumn("p", A.permutation(F.lit(1))) \
        .select(A.unpermute_answer("l", "p")).first()[0] == ""


def test_shown_correct_round_trip(spark):
    df = spark.range(40).withColumnRenamed("id", "q").withColumn("perm", A.permutation("q"))
    df = df.withColumn("correct", F.substr(F.lit("ABCD"), (F.col("q") % 4 + 1).cast("int"), F.lit(1)))
    r = df.select("correct", A.unpermute_answer(A.shown_correct("correct", "perm"), "perm").alias("back")).collect()
    assert all(x.correct == x.back for x in r)


@pytest.mark.parametrize("name,parts", [
    ("eval_gen-a_mm_RAG_no_perm_benchmark_20250101-101010.json",
     ("gen-a", "mm_RAG", "no_perm", "20250101-101010", False, True)),
    ("eval_gen-b_text_RAG_perm_benchmark_20250101-101010_perm_q.json",
     ("gen-b", "text_RAG", "perm", "20250101-101010", True, True)),
    ("eval_x_colpali_perm_benchmark_2025-bad.json", (None, None, None, None, False, False)),
])
def test_parse_run_name(spark, name, parts):
    df = A.with_run_name(spark.createDataFrame([(name,)], "f string"), "f")
    r = df.first()
    assert (r.model_short, r.vd_name, r.perm_label, r.timestamp, r.perm_suffix, r.valid) == parts


def test_precision_and_hit(spark):
    rows = [("Paper3", "['paper3_pg_1', 'Paper3_pg_2', 'x_pg_1']"), ("paper3", "['paper3_pg_1']"),
            ("General", "['General_pg_1']"), ("Paper1", ""), ("Paper1", "[broken"), (None, "['a']"),
            ("Paper2", "['Paper2_pg_1']")]
    df = spark.createDataFrame(rows, "pid string, ctx string")
    out = df.select(M.precision_at_k("pid", "ctx", 5).alias("p"), M.hit_at_k("pid", "ctx").alias("h")).collect()
    assert [r.p for r in out] == [0.4, None, None, 0.0, 0.0, None, 0.2]
    assert [r.h for r in out] == [1.0, 1.0, None, 0.0, 0.0, None, 1.0]


def test_cost_and_throughput(spark):
    df = spark.createDataFrame([("m1", 2_000_000, 4.0), ("zz", 10, 0.0)], "Model string, t long, e double")
    out = df.select(M.cost("Model", "t", {"m1": 10.0}).alias("c"), M.throughput("t", "e").alias("tp")).collect()
    assert out[0].c == pytest.approx(20.0) and out[0].tp == 500000.0
    assert out[1].c is None and out[1].tp is None


def test_format_ci_cell(spark):
    df = spark.createDataFrame([(0.5, -0.1, 0.9), (0.0625, 0.0, 1.0), (1.0, None, 2.0)], "m double, l double, u double")
    out = [r[0] for r in df.select(M.format_ci_cell("m", "l", "u", 3)).collect()]
    assert out == ["0.500\n[0.000, 0.900]", "0.062\n[0.000, 1.000]", "N/A"]


def test_t_table_against_published_quantiles():
    t = S.t975_table()
    for df, q in [(1, 12.7062), (2, 4.3027), (4, 2.7764), (30, 2.0423)]:
        assert t[df - 1] == pytest.approx(q, abs=5e-5)


def test_t_large_df(spark):
    df = spark.createDataFrame([(120,), (2000,), (100,), (101,), (0,)], "d int").select(F.expr(S.t975_sql("d")).alias("t"))
    vals = [r.t for r in df.collect()]
    # both sides of the joint of table and expansion
    assert vals[2] == pytest.approx(S.t_ppf_upper(0.025, 100), abs=1e-9)
    assert vals[3] == pytest.approx(S.t_ppf_upper(0.025, 101), abs=1e-9) and vals[4] is None
    assert vals[0] == pytest.approx(S.t_ppf_upper(0.025, 120), abs=1e-9)
    assert vals[1] == pytest.approx(S.t_ppf_upper(0.025, 2000), abs=1e-9)
    assert vals[0] == pytest.approx(1.97993, abs=1e-5)


def test_two_sided_p_is_right_far_out(spark):
    zs = [0.0, 0.3, 1.0, -1.959963984540054, 3.0, -6.0, 9.0, 15.0, 19.3, -26.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(F.expr(S.two_sided_p_sql("z"))).collect()]
    for z, p in zip(zs, got):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6, abs=0)
    assert got[-2] < 1e-80


def test_agresti_coull_and_t_interval(spark):
    df = spark.createDataFrame([(3.0, 10), (0.0, 0), (10.0, 10)], "c double, n long")
    low, upp = S.agresti_coull("c", "n")
    out = df.select(low.alias("l"), upp.alias("u")).collect()
    z = S.Z975
    nc = 10 + z * z
    qc = (3 + z * z / 2) / nc
    assert out[0].l == pytest.approx(qc - z * math.sqrt(qc * (1 - qc) / nc))
    assert out[1].l is None and out[2].u == 1.0
    vals = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double").agg(
        F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("x").alias("n"))
    lo, up = S.t_interval("m", "s", "n")
    r = vals.select("m", lo.alias("lo"), up.alias("up")).first()
    assert r.lo <= r.m <= r.up
    half = S.t975_table()[1] * math.sqrt(7 / 3) / math.sqrt(3)
    assert r.up == pytest.approx(7 / 3 + half)


def test_reference_label_and_page_label(spark):
    rows = [("Doc.pdf", None, 3, None), ("", "f.png", 0, 7), ("", None, None, None), ("", "", 0, 0)]
    df = spark.createDataFrame(rows, "d string, f string, pn int, pid int")
    out = [r[0] for r in df.select(TX.reference_label("d", "f", "pn", "pid")).collect()]
    assert out == ["Doc.pdf_pg_3", "f.png_pg_7", "doc", "doc_pg_0"]
    one = spark.createDataFrame([("Paper1.v2.pdf", 4)], "f string, p int").select(TX.page_label("f", "p")).first()[0]
    assert one == "Paper1_pg_4"


def test_extract_content(spark):
    rows = ['{"content": "A."}', '{"content": [{"type": "text", "text": "B"}, {"type": "text", "text": "!"}]}',
            '{"content": {"x": 1}}', '{}', "not json"]
    df = spark.createDataFrame([(r,) for r in rows], "m string")
    assert [r[0] for r in df.select(A.extract_content("m")).collect()] == ["A.", "B!", "", "", ""]
