"""Operator properties and brute-force checks on small fixtures."""

import math
import os
import random
import tempfile
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from ragtally.operators import collections as CO
from ragtally.operators import ingest as IN
from ragtally.operators import ordering as OR
from ragtally.operators import packing
from ragtally.operators import prompts as PR
from ragtally.operators import ranktests as RK
from ragtally.operators import retrieval as RT
from ragtally.operators import summaries as SUM
from ragtally.sources import readers as RD

SF = "/root/testdata/sf0.001"


def _vectors(spark, n, d, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(d)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def _brute_topk(points, queries, k, cosine):
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    out = []
    for qid, q in queries:
        scores = [(-sum(a * b for a, b in zip(q, v)) / ((norm(q) * norm(v)) if cosine else 1.0), i) for i, v in points]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], start=1)]
    return out


@pytest.mark.parametrize("values", [None, 64])  # one shard, many shards
@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_dense_topk_brute_force(spark, monkeypatch, metric, values):
    if values:
        monkeypatch.setattr(RT, "SHARD_VALUES", values)
    rnd = random.Random(1)
    # components far outside [-1, 1], 768 of them, and ties
    pts = [(i, [rnd.uniform(-50, 50) for _ in range(768)]) for i in range(60)] + [(100 + i, [0.0] * 768) for i in range(3)]
    qs = [(i, [rnd.uniform(-9, 9) for _ in range(768)]) for i in range(5)]
    p = spark.createDataFrame(pts, "point_id long, embedding array<double>")
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>")
    for fn in (RT.dense_topk, RT.rescore_topk) if metric == "dot" else (RT.dense_topk,):
        got = sorted(fn(p, q, 5, **({"metric": metric} if fn is RT.dense_topk else {})).collect())
        want = _brute_topk(pts, qs, 5, metric == "cosine")
        assert [(r.query_id, r.rank, r.point_id) for r in got] == [w[:3] for w in want]
        assert all(abs(r.score - w[3]) < 1e-6 for r, w in zip(got, want))


def test_dense_topk_owner_payload_and_nulls(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0], "a", "x"), (2, [0.9, 0.1], "b", "y"), (3, None, "a", "z"),
                               (4, [0.5, 0.5], "a", "w"), (5, [1.0, 0.0], None, "n")],
                              "point_id long, embedding array<double>, owner string, payload string")
    q = spark.createDataFrame([(7, [1.0, 0.0], "a"), (8, [1.0, 0.0], None), (9, None, "a")],
                              "query_id long, embedding array<double>, owner string")
    got = sorted((r.query_id, r.rank, r.point_id, r.owner, r.payload)
                 for r in RT.dense_topk(p, q, 5, on=["owner"], carry=["payload"]).collect())
    assert got == [(7, 1, 1, "a", "x"), (7, 2, 4, "a", "w")]


def test_topk_plan_shape(spark):
    pts = _vectors(spark, 50, 4, 3).withColumnRenamed("id", "point_id").withColumnRenamed("v", "embedding")
    qs = _vectors(spark, 3, 4, 4).withColumnRenamed("id", "query_id").withColumnRenamed("v", "embedding")
    plan = RT.dense_topk(pts, qs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "MapInArrow" in plan and "NestedLoop" not in plan


def test_maxsim_single_token_single_patch_is_dot(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [0.5, -1.0])], "page_key long, patch_no int, embedding array<double>")
    t = spark.createDataFrame([(9, 0, [3.0, 1.0])], "query_id long, token_no int, embedding array<double>")
    out = {r.page_key: r.score for r in RT.maxsim_topk(p, t, 5).collect()}
    assert out == {1: 5.0, 2: 0.5}


def test_maxsim_brute_force(spark):
    rnd = random.Random(7)
    patches = [(pg, j, [rnd.uniform(-1, 1) for _ in range(6)]) for pg in range(12) for j in range(5)]
    toks = [(q, j, [rnd.uniform(-1, 1) for _ in range(6)]) for q in range(3) for j in range(4)]
    p = spark.createDataFrame(patches, "page_key long, patch_no int, embedding array<double>")
    t = spark.createDataFrame(toks, "query_id long, token_no int, embedding array<double>")
    got = {(r.query_id, r.rank): (r.page_key, r.score) for r in RT.maxsim_topk(p, t, 3).collect()}
    for q in range(3):
        scores = []
        for pg in range(12):
            s = sum(max(sum(a * b for a, b in zip(tv, pv)) for (pp, _, pv) in patches if pp == pg)
                    for (qq, _, tv) in toks if qq == q)
            scores.append((-s, pg))
        for rank, (ns, pg) in enumerate(sorted(scores)[:3], start=1):
            assert got[(q, rank)][0] == pg and got[(q, rank)][1] == pytest.approx(-ns)


def test_upsert_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, version int")
    upd = spark.createDataFrame([(2, "B", 2), (3, "c", 1)], "id long, v string, version int")
    once = CO.upsert_points(base, upd, "id", "version")
    twice = CO.upsert_points(once, upd, "id", "version")
    assert sorted(once.collect()) == sorted(twice.collect()) == sorted(
        [Row(id=1, v="a", version=1), Row(id=2, v="B", version=2), Row(id=3, v="c", version=1)])


def test_shuffle_keeps_multiset(spark):
    q = spark.range(100).withColumnRenamed("id", "Question_nr")
    s = RD.shuffle_questions(q).collect()
    assert sorted(r.Question_nr for r in s) == list(range(100))
    assert [r.Question_nr for r in s] != list(range(100))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_range_sort_numbers_keep_every_row_with_a_wide_payload(spark, coalesce):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        n = 400_000
        df = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
            F.md5(F.col("id").cast("string")).alias("f"), F.repeat(F.col("id").cast("string"), 20).alias("payload"), "id")
        w = Window.partitionBy("k").orderBy("f")
        want = df.withColumn("n", F.row_number().over(w))
        check = lambda x, c: x.agg(F.count("*"), F.sum(F.xxhash64("k", "f", "payload", "id", c).cast("decimal(38,0)"))).first()
        assert check(OR.sequence_by_sort(df, ["k"], ["f"], "n"), "n") == check(want, "n")
        batches = CO.batch_rows(df, 1000, ["k"], "f")
        assert check(batches, "batch") == check(
            want.withColumn("batch", F.floor((F.col("n") - 1) / 1000).cast("int")), "batch")
        items = spark.range(n).select(F.lit("m").alias("model"), F.lit("a").alias("cond_1"), F.lit("b").alias("cond_2"),
                                      F.col("id").alias("item"), (F.rand(3) * 2 - 0.9).alias("x"), F.lit(0.0).alias("y"))
        items = items.checkpoint()
        got = RK.wilcoxon_test(items, "model", "item").first()
        ranks = items.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.abs("x"))))
        assert got.statistic == ranks.where("x > 0").agg(F.sum("r")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_sequence_by_sort_matches_row_number_with_hot_key(spark):
    rnd = random.Random(11)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", f"f{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, f string").repartition(7)
    got = OR.sequence_by_sort(df, ["k"], ["f"], "n").collect()
    w = Window.partitionBy("k").orderBy("f")
    want = df.withColumn("n", F.row_number().over(w)).collect()
    assert sorted(got) == sorted(want)


def test_running_sum_blocks(spark):
    rows = [(d, p, (p * 7) % 5) for d in range(3) for p in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "d long, p long, v long")
    got = OR.running_sum(df, ["d"], "p", "v", "cum", block=16).collect()
    w = Window.partitionBy("d").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("cum", F.sum("v").over(w)).collect()
    assert sorted(got) == sorted(want)


def test_collection_inventory_substring_semantics(spark):
    pts = spark.createDataFrame([("Paper1.pdf", "l1"), ("Paper11.pdf", "l11"), ("ab", "s"), ("", "e")],
                                "document_name string, document_link string")
    files = spark.createDataFrame([("/c/Paper1.pdf",), ("/c/old_Paper1.pdf",), ("/c/Paper11.pdf",),
                                   ("/c/tab.pdf",), ("/c/x.pdf",)], "path string")
    got = sorted((r.document_name, r.path) for r in CO.collection_inventory(pts, files).collect())
    names = ["Paper1.pdf", "Paper11.pdf", "ab"]
    paths = ["/c/Paper1.pdf", "/c/old_Paper1.pdf", "/c/Paper11.pdf", "/c/tab.pdf", "/c/x.pdf"]
    assert got == sorted((n, p) for n in names for p in paths if n in p)


def _wilcox_reference(x, y):
    d = [a - b for a, b in zip(x, y) if a is not None and b is not None]
    d = [v for v in d if v != 0]
    n = len(d)
    if n == 0:
        return 0.0, None
    absd = sorted(abs(v) for v in d)
    ranks = {}
    i = 0
    while i < n:
        j = i
        while j < n and absd[j] == absd[i]:
            j += 1
        ranks[absd[i]] = (i + 1 + j) / 2.0
        i = j
    V = sum(ranks[abs(v)] for v in d if v > 0)
    ties = {}
    for v in absd:
        ties[v] = ties.get(v, 0) + 1
    z0 = V - n * (n + 1) / 4
    sigma = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sum(t ** 3 - t for t in ties.values()) / 48)
    z = (z0 - math.copysign(0.5, z0) if z0 != 0 else 0.0) / sigma
    phi = 0.5 * math.erfc(-z / math.sqrt(2))
    return V, 2 * min(phi, 1 - phi)


def test_wilcoxon_against_brute_force(spark):
    rnd = random.Random(3)
    conds = ["c1", "c2", "c3"]
    rows = [("m", c, item, rnd.randint(0, 1)) for item in range(40) for c in conds for _ in range(3)
            if not (c == "c3" and item % 7 == 0)]
    runs = spark.createDataFrame(rows, "model string, cond string, item long, correct int")
    wide = RK.item_accuracy(runs, "model", "cond", "item", "correct", conds)
    tests = {(r.cond_1, r.cond_2): r for r in RK.wilcoxon_test(RK.item_pairs(wide, "model", "item", conds),
                                                               "model", "item").collect()}
    acc = {}
    for _, c, item, v in rows:
        acc.setdefault((c, item), []).append(v)
    for a, b in combinations(conds, 2):
        x = [sum(acc[(a, i)]) / len(acc[(a, i)]) if (a, i) in acc else None for i in range(40)]
        y = [sum(acc[(b, i)]) / len(acc[(b, i)]) if (b, i) in acc else None for i in range(40)]
        V, p = _wilcox_reference(x, y)
        r = tests[(a, b)]
        assert r.statistic == pytest.approx(V)
        assert r.p_value == pytest.approx(p, abs=1e-6)
        assert r.n_items_used == sum(1 for u, v in zip(x, y) if u is not None and v is not None)


def test_majority_tie_wins(spark):
    rows = [("m", "r", 1, "Easy", 1), ("m", "r", 1, "Easy", 0), ("m", "r", 2, "Easy", 0), ("m", "r", 2, "Easy", 0)]
    df = spark.createDataFrame(rows, "Model string, Model_ret string, Question_nr long, Difficulty string, Cor_answer int")
    out = SUM.majority_vote(df, ["Model", "Model_ret"], ["Question_nr", "Difficulty"]).first()
    assert out.majority_accuracy == 0.5


def test_ci_single_iteration_is_na(spark):
    rows = [("gen_a", "ret_a", 1, "Easy", 1, "Paper1", "['Paper1_pg_1']", 1.0, 100)]
    df = spark.createDataFrame(rows, "Model string, Model_ret string, Question_nr long, Difficulty string, "
                                     "Iteration int, Paper_id string, Context_papers string, Elapsed double, "
                                     "Total_tokens long").withColumn("Cor_answer", F.lit(1))
    r = SUM.ci_summary(df, ["Model", "Model_ret"], {"gen_a": 10.0}, 5).first()
    assert r.elapsed == "N/A" and r.cor_answer != "N/A"


def test_extract_elements_small_html(spark):
    html = ('<html><head><title>T &amp; U</title><script>var t="</p>";</script><style>p{}</style></head>'
            '<body><!-- <p>hidden</p> --><nav><ul><li><a href="/x">Nav</a></li></ul></nav>'
            '<h1>Head</h1><p><b>One</b> two<br><p>Three &lt;4&gt;</p><div>skip</div><p>   </p></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    out = [(r.kind, r.text) for r in IN.extract_elements(df).orderBy("pos").collect()]
    assert out == [("title", "T & U"), ("list_item", "Nav"), ("heading", "Head"), ("text", "One two"),
                   ("text", "Three <4>"), ("text", "skip")]


def test_chunk_rule(spark):
    lines = [(1, i, " ".join(["w"] * n), "text", 1) for i, n in enumerate([3, 3, 3, 5, 1])]
    df = spark.createDataFrame(lines, "doc_id long, pos int, line string, type string, page_no int")
    out = sorted((r.chunk, r.n_tokens) for r in IN.chunk_text(df, budget=6, block=2).collect())
    # whole lines while they fit: 3 + 3, then 3 (five more don't fit), then 5 + 1
    assert out == [(0, 6), (1, 3), (2, 6)]


def packed_one_by_one(sizes, budget):
    """Sequential packer: (line, first word, end word) of each chunk's pieces."""
    chunks, fill = [[]], 0
    for i, n in enumerate(sizes):
        for lo in range(0, max(n, 1), budget):
            hi = min(lo + budget, n)
            if fill + hi - lo > budget:
                chunks.append([])
                fill = 0
            chunks[-1].append((i, lo, hi))
            fill += hi - lo
    return chunks


@pytest.mark.parametrize("block", [16, 4096])
def test_chunks_are_those_of_a_sequential_packer(spark, block):
    rnd = random.Random(8)
    docs = {d: [rnd.choice([0, 1, 3, 9, 20, 64, 65, 300]) for _ in range(n)] for d, n in ((1, 10_000), (2, 16), (3, 17), (4, 1))}
    words = lambda d, p, n: [f"{d}.{p}.{i}" for i in range(n)]
    rows = [(d, p, "  ".join(words(d, p, n)), ["text", "table"][p % 2], p // 9) for d, of in docs.items() for p, n in enumerate(of)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, line string, type string, page_no int").repartition(5)
    got = {(r.doc_id, r.chunk): (r.n_lines, r.n_tokens, r.first_page, r.ref, r.text, r.lone_table)
           for r in IN.chunk_text(df, 64, block=block).collect()}
    want = {}
    for d, of in docs.items():
        for c, parts in enumerate(packed_one_by_one(of, 64)):
            text = [("  " if hi - lo == of[p] else " ").join(words(d, p, of[p])[lo:hi]) for p, lo, hi in parts]
            want[d, c] = (len(parts), sum(hi - lo for _, lo, hi in parts), parts[0][0] // 9,
                          " ".join(f"#/lines/{p}" for p, _, _ in parts), "\n".join(text),
                          len(parts) == 1 and parts[0][0] % 2 == 1)
    assert got == want


def test_attach_image_payloads(spark):
    d = tempfile.mkdtemp(prefix="ragtally-img-")
    with open(os.path.join(d, "a.png"), "wb") as fh:
        fh.write(b"\x89PNG-bytes")
    images = spark.read.format("binaryFile").load(d)
    path = images.first().path
    msgs = spark.createDataFrame([(1,)], "q long").select(
        "q", PR.single_message(F.lit("look"), F.array(F.lit(path))).alias("message"))
    out = PR.attach_image_payloads(msgs, images, ["q"]).first().message
    assert out[0].text == "look" and out[1].url == "data:image/jpeg;base64,iVBORy1ieXRlcw=="


def test_maxsim_packed_equals_exploded(spark):
    rnd = random.Random(13)
    patches = [(pg, j, [rnd.uniform(-1, 1) * (j + 1) for _ in range(8)]) for pg in range(30) for j in range(6)]
    toks = [(q, j, [rnd.uniform(-1, 1) for _ in range(8)]) for q in range(4) for j in range(3)]
    p = spark.createDataFrame(patches, "page_key long, patch_no int, embedding array<double>")
    t = spark.createDataFrame(toks, "query_id long, token_no int, embedding array<double>")
    for norm in (False, True):
        a = RT.maxsim_topk(p, t, 4, normalize=norm).collect()
        b = RT.maxsim_topk_packed(RT.pack_patches(p), t, 4, normalize=norm).collect()
        key = lambda r: (r.query_id, r.rank)
        a, b = sorted(a, key=key), sorted(b, key=key)
        assert [(r.query_id, r.rank, r.page_key) for r in a] == [(r.query_id, r.rank, r.page_key) for r in b]
        assert all(abs(x.score - y.score) < 1e-9 for x, y in zip(a, b))


def test_report_plans_write_and_read(spark):
    from ragtally.plans import reports as RPT
    from ragtally.session import scratch_path
    from ragtally.sources import fixtures as FX
    from ragtally.sources import sinks as SK

    ev = FX.fx_eval(spark, SF)
    sheets = RPT.ci_report(spark, ev, FX.PRICES, 5, FX.MODELS, FX.RETRIEVERS)
    sheets.update(RPT.sd_report(ev, FX.MODELS, FX.RETRIEVERS))
    paths = SK.write_report(sheets, scratch_path(spark, "report-test"), csv=False)
    back = {k: spark.read.parquet(v).count() for k, v in paths.items()}
    assert back["Descriptions"] == 7 and back["diff_topk5"] > 0 and back["Summary"] > 0
    mcq = FX.fx_mcq(spark, SF)
    answers = (FX.fx_responses(spark, SF).withColumn("answer", F.lit("A"))
               .withColumn("model_short", F.lit("gen-a"))
               .withColumn("vd_name", F.when(F.col("turn") % 2 == 0, "mm_RAG").otherwise("no_RAG"))
               .withColumn("perm_label", F.lit("perm")))
    rep = RPT.exp1_report(answers, mcq)
    assert set(rep["Accuracy"].columns) >= {"Easy", "Medium", "Hard"}
    assert rep["Full"].count() == answers.count()


def test_stream_upsert_replay_is_idempotent(spark):
    from ragtally.session import scratch_path
    from ragtally.streaming import incremental as ST
    from pyspark.sql import types as T

    root = scratch_path(spark, "stream-test")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()),
                           T.StructField("version", T.IntegerType())])
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.parquet(f"{root}/src")
    first = ST.stream_upsert(spark, f"{root}/src", schema, f"{root}/out", "id", "version")
    assert sorted((r.id, r.v) for r in first.collect()) == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "B", 2), (3, "c", 1)], schema).write.mode("append").parquet(f"{root}/src")
    second = ST.stream_upsert(spark, f"{root}/src", schema, f"{root}/out", "id", "version")
    again = ST.stream_upsert(spark, f"{root}/src", schema, f"{root}/out", "id", "version")  # nothing new
    assert sorted((r.id, r.v) for r in second.collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(again.collect()) == sorted(second.collect())


def test_ensure_collection_and_dimension_check(spark):
    from ragtally.session import scratch_path
    path = scratch_path(spark, "coll")
    schema = "point_id long, embedding array<float>"
    c = CO.ensure_collection(spark, path, schema, "embedding", 3)
    assert c.count() == 0 and c.schema["embedding"].metadata == {"dim": 3, "distance": "cosine"}
    spark.createDataFrame([(1, [1.0, 2.0, 3.0])], schema).write.mode("append").parquet(path)
    assert CO.ensure_collection(spark, path, schema, "embedding", 3).count() == 1
    bad = spark.createDataFrame([(2, [1.0])], schema)
    with pytest.raises(Exception):
        CO.create_collection(bad, "embedding", 3).collect()


def test_sequence_by_sort_null_keys(spark):
    rows = [(None, "b"), (None, "a"), ("x", "c"), ("x", "a"), (None, "c")]
    df = spark.createDataFrame(rows, "k string, f string").repartition(3)
    got = sorted(OR.sequence_by_sort(df, ["k"], ["f"], "n").collect(), key=lambda r: (str(r.k), r.f))
    assert [(r.k, r.f, r.n) for r in got] == [(None, "a", 1), (None, "b", 2), (None, "c", 3),
                                             ("x", "a", 1), ("x", "c", 2)]


def test_extract_tables_and_images(spark):
    html = ('<html><body><table><caption>Table 1: doses</caption><tr><th>drug</th><th>mg</th></tr>'
            '<tr><td><b>A</b></td><td>5 &amp; 6</td></tr></table>'
            '<table><tr><td>x</td></tr></table><img src="/img/f1.png" alt="Figure 1 &lt;mice&gt;">'
            '<IMG SRC=\'f2.jpg\'></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    t = IN.extract_tables(df).orderBy("table_no").collect()
    assert t[0].page_content == "Table 1: doses | drug | mg |\n| A | 5 & 6 |"
    assert t[1].caption == "" and t[1].page_content == "| x |"
    imgs = IN.extract_images(df).orderBy("image_no").collect()
    assert [(r.img_link, r.caption) for r in imgs] == [("/img/f1.png", "Figure 1 <mice>"), ("f2.jpg", "")]


def test_table_grids(spark):
    from ragtally.operators.tables import tables_of

    grids = lambda html: [(t[1].strip(), t[2], t[3]) for t in tables_of(html)]
    # column and row spans fill the places they cover; a row span ends with its group
    spans = ("<table><thead><tr><th rowspan=2>drug<th colspan='2'>dose</tr><tr><th>low<th>high</tr></thead>"
             "<tbody><tr><td rowspan=9>A<td>1<td>2<tr><td>3</tbody><tbody><tr><td>B</tbody></table>")
    assert grids(spans) == [("", [["drug", "dose", "dose"], ["drug", "low", "high"], ["A", "1", "2"], ["A", "3", ""],
                                  ["B", "", ""]], 2)]
    # a nested table is one of its own, numbered by where it begins; its caption and cells stay out of the outer cell
    nested = ("<table><caption>out<b>er</b></caption><tr><td>x<table><caption>inner</caption><tr><td>1</td></tr></table>y</td>"
              "<td>z</td></tr></table><table><tr><td>after")
    assert grids(nested) == [("out er", [["x y", "z"]], 0), ("inner", [["1"]], 0), ("", [["after"]], 0)]
    # rowspan 0 reaches to the end; a column span stops at a cell from above; spans without use are no rows
    assert grids("<table><tr><td>a<td rowspan=0>b<td>c<tr><td colspan=5>d<tr><td rowspan=65534 colspan=0>e</table>") == [
        ("", [["a", "b", "c"], ["d", "b", ""], ["e", "b", ""]], 0)]
    assert grids("<table></table><table><tr></table></table><p>") == [("", [], 0), ("", [[]], 0)]
    assert grids("no table, 3 < 4") == grids("") == [] and len(tables_of("<table><a " + "<a " * 100000)) == 1
    # random grids of unit cells come back as they are
    import random
    rng = random.Random(1)
    want = [[[str(rng.random()) for _ in range(w)] for _ in range(rng.randint(1, 9))] for w in range(1, 12)]
    html = "".join("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in t) + "</table>" for t in want)
    assert [g[1] for g in grids(html)] == want

    df = spark.createDataFrame([(1, spans), (2, None), (3, ""), (4, nested + "<script><table></script>")], "page_id long, html string")
    got = {(r.page_id, r.table_no): r for r in IN.extract_tables(df, header_rule=True).collect()}
    assert sorted(got) == [(1, 0), (4, 0), (4, 1), (4, 2)]
    assert got[1, 0].markdown.split("\n")[:4] == ["| drug | dose | dose |", "| drug | low | high |", "| --- | --- | --- |", "| A | 1 | 2 |"]
    assert (got[1, 0].n_rows, got[1, 0].n_cols, got[1, 0].n_header) == (5, 3, 2)
    assert got[4, 0].page_content == "out er | x y | z |"


def test_unregistered_helpers(spark):
    from ragtally.operators import scoring as SC
    from ragtally.plans import run_plan as RP

    gens = spark.createDataFrame([("g1",), ("g2",)], "generator string")
    plan = RP.exp2_plan(gens, "generator", ["r1", "r2", "r3"], 5)
    assert plan.count() == 30 and plan.select("iteration").distinct().count() == 5
    pages = spark.createDataFrame([("Paper7", 3), ("Paper7", 1234)], "stem string, page_no int")
    links = [r.img_link for r in IN.page_image_links(pages, "stem", "page_no", "pg/").collect()]
    assert links == ["pg/Paper7_003.png", "pg/Paper7_1234.png"]
    files = spark.createDataFrame([("eval_m_text_RAG_perm_benchmark_20250101-000000.json",),
                                   ("eval_m_text_RAG_benchmark_x.json",), ("notes.txt",)], "file_name string")
    assert [r.file_name for r in SC.reject_run_files(files).collect()] == ["eval_m_text_RAG_benchmark_x.json"]


def test_elements_keep_text_around_any_tag(spark):
    html = ("<html><body>lead<p>alpha <mark>beta</mark><br/>gam<b>ma</b><h5>Deep</h5><div>in div<ul><li>one<li>two</ul>tail</div>"
            "<table><tr><td>c1</td><th>c2</th></tr></table><p>&#8364; &#x1F600; &#xZ; 5 &lt; 6 &#0; AT&amp;T &#39;q&#39;</p>"
            "<script>p('<p>no</p>')</script><custom-tag>x</custom-tag>")
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = [(r.tag, r.kind, r.text) for r in IN.extract_elements(pages).orderBy("page_id", "pos").collect()]
    assert got == [("body", "text", "lead"), ("p", "text", "alpha beta gamma"), ("h5", "heading", "Deep"),
                   ("div", "text", "in div"), ("li", "list_item", "one"), ("li", "list_item", "two"),
                   ("text", "text", "tail"), ("td", "table_cell", "c1"), ("th", "table_cell", "c2"),
                   ("p", "text", "€ 😀 &#xZ; 5 < 6 � AT&T 'q'"), ("text", "text", "x")]


def test_chunks_never_exceed_the_budget(spark):
    rnd = random.Random(4)
    rows = [(d, p, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.choice([0, 1, 5, 40, 900]))), 1)
            for d in range(6) for p in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, line string, page_no int")
    chunks = IN.chunk_text(df, 64, block=7).collect()
    assert max(r.n_tokens for r in chunks) == 64 and all(len(r.text.split()) == r.n_tokens for r in chunks)
    for d in range(6):
        text = " ".join(r.text for r in sorted((r for r in chunks if r.doc_id == d), key=lambda r: r.chunk))
        assert text.split() == " ".join(r[2] for r in rows if r[0] == d).split()


def test_inventory_many_names_of_one_prefix(spark):
    names = [f"Paper{i}.pdf" for i in range(10_000)]
    pts = spark.createDataFrame([(n, "l", "u1") for n in names] + [("ab", "s", "u1"), ("zz", "s", "u2")],
                                "document_name string, document_link string, username string")
    paths = [f"/c/old_Paper{i}.pdf" for i in range(0, 10_000, 100)] + ["/c/tab.pdf", "/c/zz", "p"]
    files = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    got = {(r.document_name, r.path) for r in CO.collection_inventory(pts, files, owner="u1").collect()}
    # a path that ends in Paper{i}.pdf holds the name Paper{i}.pdf only
    assert got == {(f"Paper{i}.pdf", f"/c/old_Paper{i}.pdf") for i in range(0, 10_000, 100)} | {("ab", "/c/tab.pdf")}


def test_stored_orders_differ_by_run_and_score_back(spark):
    from ragtally.functions import answers as A
    from ragtally.operators import scoring as SC
    reqs = spark.createDataFrame([(run, q) for run in range(12) for q in range(3)], "run long, Question_nr long")
    reqs = SC.request_orders(reqs, run_col="run")
    orders = reqs.collect()
    assert len({(r.Question_nr, tuple(r.quest_order)) for r in orders}) > 20
    shown = reqs.withColumn("raw_response", A.shown_correct(F.lit("C"), "quest_order"))
    assert {r.answer for r in SC.score_responses(shown).collect()} == {"C"}


def test_two_step_drops_null_groups(spark):
    ev = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), (None, 1, 1.0), ("a", None, 1.0)],
                               "Model string, Question_nr long, Cor_answer double")
    got = SUM.two_step_summary(ev, ["Model"], {"Cor_answer": "proportion"}, text=False).collect()
    assert [(r.Model, r.mean_Cor_answer) for r in got] == [("a", 0.5)]


def test_change_log_is_compacted(spark):
    from pyspark.sql import types as T

    from ragtally.streaming import incremental as ST
    root = tempfile.mkdtemp(prefix="ragtally-compact-")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()),
                           T.StructField("version", T.IntegerType())])
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "B", 2)], [(1, "old", 0), (3, "c", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/src")
        got = sorted(tuple(r) for r in ST.stream_upsert(spark, f"{root}/src", schema, f"{root}/out", "id", "version").collect())
        assert ST._newest_state(spark, f"{root}/out") == i
    assert got == [(1, "a", 1), (2, "B", 2), (3, "c", 1)]
    assert sorted(tuple(r) for r in ST.collection_state(spark, f"{root}/out", "id", "version", ["id", "v", "version"]).collect()) == got


def test_vectorise_text_deals_documents_by_their_length(spark, monkeypatch):
    """Shares of the table that do not grow with it, repeated and null ids included; the same vectors."""
    docs = spark.createDataFrame([(i % 40, f"Word{i % 7} Word{i} the") for i in range(60)] + [(None, "the end"), (41, None)],
                                 "doc_id long, text string")
    want = sorted(map(str, IN.vectorise_text(docs, "text", 16).collect()))
    monkeypatch.setattr(IN, "PART_CHARS", 100)
    many = IN.vectorise_text(docs, "text", 16)
    assert sorted(map(str, many.collect())) == want
    chars = sum(len(r.text or "") for r in docs.collect())
    assert str(-(-(chars + 42 * 16) // 100)) + "), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()


def test_packing_holds_bounded_slices_of_a_batch():
    b = pa.record_batch({"items": [[1] * n for n in (3, 2, 9, 1, 1, 0, 4)]})
    parts = [x.column("items").to_pylist() for x in packing.slices(b, "items", 5)]
    assert [[len(x) for x in p] for p in parts] == [[3, 2], [9], [1, 1, 0], [4]]
    rows = pa.record_batch({"doc": [1, 2, 3], "block": [0, 0, 0], "fill": [0, 0, 0], "chunk": [0, 0, 0], "items": [
        [{"pos": k, "n": 2, "line": f"a b{k}", "page": 1, "type": "text"} for k in range(packing.LINES - 1)]] * 3})
    out = list(packing._Pack("doc", 512)(iter([rows])))
    assert len(out) == 3 and sum(x.num_rows for x in out) == 3 * 64
