"""The operators and the pipeline on small tables with nulls, empty and long texts, ties, repeated rows, clashing
column names, and on empty tables; results against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ragtally.llm import (bpe, common, html_extract, langid, mixing, quality, simhash, substring, suffix_dedup, topk,
                          toxicity)

from .test_llm_kernels import covered

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["size", "key", "hash", "fp", "score", "copies", "bucket", "shard", "node", "rid", "row_key", "spans", "n",
           "taken", "target", "weight", "block", "chunk", "label", "toxic"]


def rows(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, out = text(90), []
    for i in range(n):
        t = text(rnd.randint(1, 80))
        if i % 5 == 0:
            t += "\n" + passage + "  " + text(10)
        if i % 17 == 3:
            t = out[i - 1][1]
        out.append((i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "Z"][i % 4], len(t)))
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n\t", "en", "s1", 3),
            (103, "x" * 3000 + " " + text(4000), "en", "s1", None), (104, "one", "xx", "s9", 3),
            (None, text(50), "en", "s1", None), (None, text(50), "de", "s2", None), (None, None, None, None, None)]
    return out + [out[7], out[7], out[-2]]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(rows(), COLUMNS).repartition(3)
    for c in CLASHES:
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def collected(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_suffix_dedup(docs, empty):
    texts = [(r[1] or "").encode() for r in rows()]
    want = Counter()
    for r, t, mark in zip(rows(), texts, covered(texts, suffix_dedup.SIZE)):
        runs = int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~mark])
        want[r[0], len(t), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    got = collected(suffix_dedup.reduced(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want and sum(k[2] for k in want) > 3000
    assert suffix_dedup.reduced(empty).count() == 0


def test_suffix_dedup_hot_anchors_give_the_same(docs, monkeypatch):
    want = collected(suffix_dedup.reduced(docs), "doc_id", "n_removed", "kept_sha256")
    monkeypatch.setattr(suffix_dedup, "HOT_AT", 3)
    assert collected(suffix_dedup.reduced(docs), "doc_id", "n_removed", "kept_sha256") == want


def test_suffix_dedup_keeps_rows_and_columns(docs, empty):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [(r[1] or "").encode() for r in rows()]
    want = Counter((r[0], None if r[1] is None else bytes(np.frombuffer(t, np.uint8)[~m]).decode())
                   for r, t, m in zip(rows(), texts, covered(texts, suffix_dedup.SIZE)))
    assert collected(out, "doc_id", "text") == want  # the texts are ASCII
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_substring_dedup(docs, empty):
    words = [tuple((r[1] or "").encode().split()) for r in rows()]
    want = Counter((r[0], len(w), int(m.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, m) if not y)).hexdigest())
                   for r, w, m in zip(rows(), words, covered(words, substring.WINDOW)))
    assert collected(substring.reduced(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring.reduced(empty).count() == 0


def test_substring_dedup_tells_words_of_equal_polynomials(spark):
    word = "a"  # Thue-Morse words: equal under any polynomial modulo 2^64
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(34))
    texts = [word + " " + shared, word.translate(str.maketrans("ab", "ba")) + " " + shared]
    got = substring.reduced(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS))
    assert collected(got, "doc_id", "n_words", "n_removed") == Counter({(0, 35, 0): 1, (1, 35, 0): 1})


def components_by_hand(data):
    fps = [simhash.fingerprint(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(data)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS:
                parent[find(i)] = find(j)
    groups = [find(i) for i in range(len(data))]
    least = {g: min((r[0] for r, h in zip(data, groups) if h == g and r[0] is not None), default=None) for g in groups}
    return fps, groups, least


def near(seed):
    """Documents in chains of near copies."""
    rnd = random.Random(seed)
    out, i = [], 0
    for _ in range(15):
        words = [str(rnd.randint(0, 10 ** 6)) for _ in range(300)]
        for _ in range(rnd.randint(1, 6)):
            words[rnd.randrange(len(words))] = "changed"
            out.append((rnd.randint(0, 10 ** 6) if i % 9 else None, " ".join(words), "en", "s", 1))
            i += 1
    return out


@pytest.mark.parametrize("block", [8192, 4])
def test_simhash_components(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    data = rows() + near(3)
    fps, groups, least = components_by_hand(data)
    assert len(set(groups)) < len(set(fps))
    got = collected(simhash.components(spark.createDataFrame(data, COLUMNS)), "doc_id", "fp", "component_id")
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == Counter((r[0], f, least[g]) for r, f, g in zip(data, signed, groups))


def test_simhash_survivors(spark, docs, empty):
    data = rows() + near(4)
    d = spark.createDataFrame(data, COLUMNS)
    _, groups, least = components_by_hand(data)
    out = simhash.survivors(d).collect()
    assert len(out) == len(set(groups))
    assert Counter(r.doc_id for r in out) == Counter(least.values())
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(components_by_hand(rows())[1]))
    assert simhash.survivors(empty).count() == 0 and simhash.components(empty).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in common.smallest_reachable(
        spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}


def test_numbered(spark):
    d = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("x")).repartition(5)
    got = {r.x: r.n for r in common.numbered(d, [F.col("x")], "n").collect()}
    assert [got[x] for x in sorted(got)] == list(range(5000))


def test_quality_counts_and_verdict(docs, empty):
    def by_hand(text):
        w = (text or "").encode().split()
        c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        return (len(w), len("".join(x.decode() for x in w)), sum((text or "").count(s) for s in "#*$%&|<>"),
                len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))
    got = quality.judge(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(got, *names) == Counter((r[0], *by_hand(r[1])) for r in rows())
    assert not got.where("kept and base_failed").count() and got.where("kept is null").count() == 0
    assert quality.judge(empty).count() == 0


def test_quality_repeated_windows_and_outliers(spark):
    rnd = random.Random(2)
    text = lambda k: " ".join(str(rnd.randint(0, 10 ** 6)) for _ in range(k))
    passage = text(9)
    data = [(i, text(100), "en", "s", 1) for i in range(80)]
    data += [(200, text(40) + " " + passage + " " + text(40) + "\n" + passage, "en", "s", 1),
             (201, " ".join(w + "$$$" for w in text(100).split()), "en", "s", 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, COLUMNS)).collect()}
    assert got[200].n_repeat_words == 18 and got[200].kept and not got[201].kept and not got[201].base_failed
    assert all(got[i].kept for i in range(80))


def test_quality_limits_follow_the_group(spark):
    rnd = random.Random(3)
    word = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    text = lambda k=60, n=(4, 6): " ".join(word(rnd.randint(*n)) for _ in range(k))
    marked = lambda: " ".join(w + "%" * (i % 5 == 0) for i, w in enumerate(text().split()))
    lined = lambda: text(30) + "\nsame line\n" + text(30) + "\nsame line"
    passage = text(9)
    twice = lambda: f"{text(40)} {passage} {text(40)} {passage}"
    long = lambda: text(60, (9, 11))
    odd = [marked, lined, twice, long]
    data = [(1000 * g + i, text(), "en", f"plain{g}", 1) for g in range(2) for i in range(400)]
    for g, habit in enumerate(odd):  # a source of each habit, and one text of each habit in a plain source
        data += [(10_000 + 1000 * g + i, habit(), "en", f"odd{g}", 1) for i in range(400)]
        data.append((20_000 + g, habit(), "en", "plain0", 1))
    data.append((30_000, "few words", "xx", "lone", 1))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, COLUMNS)).collect()}
    assert len(got) == len(data) and not any(r.base_failed for r in got.values() if r.doc_id < 30_000)
    assert got[30_000].base_failed and got[30_000].kept is False
    assert not any(got[20_000 + g].kept for g in range(4))
    kept = lambda start: sum(got[start + i].kept for i in range(400))
    assert kept(0) >= 380 and kept(1000) >= 380 and all(kept(10_000 + 1000 * g) >= 380 for g in range(4))


def shares(sizes):
    """Targets by hand: raise the caps one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(capped.values())
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        of = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if of[s] >= 2 * sizes[s]]
        if not above:
            return capped | of
        capped |= {s: 2.0 * sizes[s] for s in above}


def test_mix(docs, empty):
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += size(r[1])
    want = shares(dict(sizes))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows()) and Counter((r.doc_id, r.size) for r in got) == Counter(
        (r[0], size(r[1])) for r in rows())
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
    longest = {s: max(size(r[1]) for r in rows() if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 2 * longest[s] for s in sizes)
    assert collected(mixing.mix(docs.repartition(7)), "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_follows_the_order_of_keys(spark):
    data = [(i, "w " * (1 + i % 7), "en", "abc"[i % 3], 1) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, COLUMNS)).collect()
    for s in "abc":
        own = sorted((r for r in got if r.source == s), key=lambda r: r.key)
        assert [r.copies for r in own] == sorted((r.copies for r in own), reverse=True)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7


@pytest.mark.parametrize("ident", [None, 7])
def test_mix_takes_equal_rows_one_by_one(spark, ident):
    words = "w " * 10
    data = [(ident, words, "en", "a", 1)] * 1000
    got = mixing.mix(spark.createDataFrame(data, COLUMNS).repartition(5)).collect()
    assert len(got) == 1000 and sum(r.taken for r in got) == got[0].target == 15_000
    # rows that differ in lang only, a row of another source, rows without words
    data += [(ident, words, "de", "a", 1)] * 500 + [(1, words, "en", "b", 1)] + [(ident, "", "en", "a", 1)] * 9
    d = spark.createDataFrame(data, COLUMNS)
    got = mixing.mix(d).collect()
    assert len(got) == len(data)
    assert abs(sum(r.taken for r in got if r.source == "a") - next(r.target for r in got if r.source == "a")) <= 5
    mixed = [mixing.mixed_documents(d.repartition(n, "doc_id", "lang")).collect() for n in (1, 6)]
    assert Counter(mixed[0]) == Counter(mixed[1]) and len(mixed[0]) == sum(r.copies for r in got)
    assert max(Counter(mixed[0]).values()) <= 2000


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [16_000_000, 500])
def test_bpe_round_trip(spark, docs, empty, tokenizer, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", chunk)
    ranks, library = tokenizer
    extra = [(300, "Ünïcode 文字 😀 it's  \n\n x\x00y", "en", "s", 1), (301, "z" * 700 + " " * 600, "en", "s", 1)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([e[:2] for e in extra], "doc_id long, text string"))
    want = Counter()
    for r in rows() + extra:
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = bpe.digests(d, ranks, public_tokenizers.PATTERN)
    assert collected(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.digests(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_toxicity_learns_and_handles_edges(spark, docs, empty):
    rnd = random.Random(6)
    plain, bad = [f"word{i}" for i in range(200)], ["scum", "moron", "idiot", "loser"]
    data, marks = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        data.append((i, " ".join(rnd.choice(bad) if toxic and k % 20 == 3 else rnd.choice(plain) for k in range(60)),
                     "en", "s", 1))
        marks.append((i, int(toxic), "x"))
    d = spark.createDataFrame(data, COLUMNS)
    labels = spark.createDataFrame(marks + [(None, 1, "x"), (3, None, "x"), (9, 0, "x"), (9, 0, "x")],
                                   "doc_id long, toxic int, text string")
    model = toxicity.train(d, labels)
    held = [r for r in toxicity.score(d, model).collect() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == int(r.doc_id % 8 == 0) for r in held]) > 0.98
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(rows()) and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in scores)
    none = toxicity.train(empty, labels)
    assert toxicity.score(empty, none).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.score(docs, none).collect())


def test_toxicity_ratios_by_hand(spark):
    """Log ratios of discounted counts over continuation counts that both classes share; none is cut off."""
    unit, rnd = toxicity.UNIT, random.Random(17)
    data = [(i, rnd.randint(0, 90) * unit, rnd.randint(0, 12) * unit, rnd.randint(1, 9)) for i in range(400)]
    counts = spark.createDataFrame(data, "bucket long, ordinary long, toxic long, contexts long")
    bucket, columns = toxicity.ratios(counts)
    o, t, c = (np.array(x, dtype=float) for x in list(zip(*data))[1:])
    for column, d in zip(columns.T, toxicity.DISCOUNTS):
        if d > 8:
            continue
        share = np.minimum(t, d * unit).sum() / t.sum()
        low, high = 0.0, o.max()
        for _ in range(80):
            cut = (low + high) / 2
            low, high = (cut, high) if np.minimum(o, cut).sum() < share * o.sum() else (low, cut)
        p = [np.maximum(x - k, 0) / x.sum() + share * c / c.sum() for x, k in ((t, d * unit), (o, low))]
        want = np.log(p[0] / p[1])
        got = np.zeros(400)
        got[bucket] = column
        assert np.abs(got - want).max() < 0.02
        assert d > 1 or ((np.abs(want) < 1) & (np.abs(got) > 0.1)).sum() > 50


def test_toxicity_tries_every_discount_whatever_is_sent(spark, monkeypatch):
    """A table of more expressions than are sent gives the ratios and scores that it gives when all are sent."""
    unit, rnd = toxicity.UNIT, random.Random(19)
    counts = spark.createDataFrame([(i, rnd.randint(0, 90) * unit, rnd.randint(0, 12) * unit, rnd.randint(1, 9)) for i in range(400)],
                                   "bucket long, ordinary long, toxic long, contexts long")
    with monkeypatch.context() as few:
        few.setattr(toxicity, "MOST_SENT", 20)
        assert toxicity.ratios(counts)[1].shape[1] == len(toxicity.DISCOUNTS)
    words, odd = [f"word{i}" for i in range(60)], [f"odd{i}" for i in range(60)]
    text = lambda bad: " ".join(rnd.choice(odd if rnd.random() < (.6 if bad else .2) else words) for _ in range(150))
    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(900)]
    d = spark.createDataFrame(data + data[:9] + [(1000, None, 0), (None, text(1), 1), (1001, "", 1), (1002, "nothing known", 0)],
                              "doc_id long, text string, toxic int")
    labels = d.where("doc_id < 1000").select("doc_id", "toxic")
    scores = lambda m: sorted((r.doc_id or -1, r.score) for r in toxicity.score(d, m).collect())
    whole = toxicity.train(d, labels)
    assert whole.rest is None
    want, calm = scores(whole), Counter(toxicity.ordinary(d, whole).collect())
    for most in (20, 0):
        monkeypatch.setattr(toxicity, "MOST_SENT", most)
        model = toxicity.train(d, labels)
        assert len(model.buckets) <= most and model.rest.count() + len(model.buckets) == len(whole.buckets)
        got = scores(model)
        assert [x[0] for x in got] == [x[0] for x in want] and np.abs(np.array([x[1] for x in got]) - [x[1] for x in want]).max() < 1e-6
        assert model.value(" ".join(odd)) == pytest.approx(whole.value(" ".join(odd)), abs=1e-6)
        assert Counter(toxicity.ordinary(d, model).collect()) == calm and 0 < sum(calm.values()) < d.count()


def test_pipeline_toxicity_stage_leaves_no_rows_or_discounts_out(spark, tmp_path, monkeypatch):
    """The stage keeps the same documents, by the same curve, whatever is sent and however many rows the curve has."""
    rnd = random.Random(20)
    words, odd = [f"word{i}" for i in range(60)], [f"odd{i}" for i in range(60)]
    text = lambda bad: " ".join(rnd.choice(odd if rnd.random() < (.5 if bad else .3) else words) for _ in range(30))
    data = [(i, text(i % 4 == 0), "en", "s1", 1) for i in range(900)] + [(None, text(1), None, None, 1), (7, None, "en", "s1", 0)]
    d = spark.createDataFrame(data, COLUMNS)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(900)]
    labels = spark.createDataFrame(labels + labels[:20] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model, calm = toxicity.train(d, labels), Counter(corpus_pipeline.drop_toxic(spark, d, str(tmp_path)).collect())
    assert 0 < sum(calm.values()) < len(data)
    for name in ("CURVE_ROWS", "MOST_SENT"):
        monkeypatch.setattr(toxicity, name, 20, raising=False)
        again = toxicity.train(d, labels)
        assert (again.slope, again.middle) == pytest.approx((model.slope, model.middle), rel=1e-6)
        assert Counter(corpus_pipeline.drop_toxic(spark, d, str(tmp_path)).collect()) == calm


def test_toxicity_curves_by_sums_over_the_rows(spark):
    rnd = np.random.default_rng(21)
    toxic = (rnd.random(3000) < .2).astype(int)
    values = np.column_stack((rnd.normal(toxic * .1, .05), rnd.normal(size=3000), -toxic, np.zeros(3000)))
    kind = "values array<double>, toxic int"
    table = spark.createDataFrame(list(zip(values.tolist(), toxic.tolist())), kind).repartition(7)
    got = toxicity.fit_curves(table, 4)
    want = {i: c for i in range(4) if (c := toxicity.fit_curve(values[:, i], toxic))}
    assert got.keys() == want.keys() and 0 in got and 2 not in got
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i in got)
    assert toxicity.fit_curves(table.where("toxic = 0"), 4) == toxicity.fit_curves(table.limit(0), 4) == {}


def test_toxicity_of_many_moderately_toxic_words(spark):
    """Each of the words is three times as frequent in toxic texts, none much more."""
    rnd = random.Random(18)
    words, odd = [f"word{i}" for i in range(60)], [f"odd{i}" for i in range(60)]
    text = lambda bad: " ".join(rnd.choice(odd if rnd.random() < (.6 if bad else .2) else words) for _ in range(150))
    d = spark.createDataFrame([(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(900)], "doc_id long, text string, toxic int")
    model = toxicity.train(d, d.select("doc_id", "toxic"))
    assert model.value(" ".join(odd)) > 0.3
    held = [r for r in toxicity.score(d, model).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95


def test_toxicity_counts_large_groups_of_copies(spark):
    rnd = random.Random(16)
    text = lambda k: " ".join(f"word{rnd.randint(0, 100)}" for _ in range(k))
    shared = "aaa bbb ccc ddd eee "
    bad = F.element_at(F.array(*[F.lit(f"{shared} {text(3)} scum") for _ in range(4)]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = spark.range(16_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")).withColumn("text", bad)
    d = d.unionByName(spark.createDataFrame([(i, 0, text(60)) for i in range(16_000, 16_600)], d.schema))
    # some 2,400 learned copies of each text count as one, not as nothing
    assert toxicity.train(d, d.select("doc_id", "toxic")).value("scum") > 0


def test_language_id_held_out(spark, docs, empty):
    rnd = random.Random(7)
    syllables = {"en": "th er on an re he in ed", "de": "ei ch sch un ge ie au tz", "fr": "ou ai eu qu en on é ç",
                 "es": "ci ón os ad ll ñ ar í"}
    data = []
    for i in range(400):
        a = list(syllables)[i % 4]
        s = syllables[a].split()
        data.append((i, " ".join("".join(rnd.choice(s) for _ in range(3)) for _ in range(25)), a if i % 31 else None, "s", 1))
    d = spark.createDataFrame(data, COLUMNS)
    model = langid.train(d)
    held = [r for r in langid.predict(d, model).collect() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == list(syllables)[r.doc_id % 4] for r in held]) > 0.98
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows())
    assert all((r.lang_pred == "und") == (r.doc_id in (100, 101, 102)) for r in got if r.doc_id is not None)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


def test_html_extraction(spark):
    page = "<body><div id=top>Welcome to the site</div><div class=text><h2>Title {0}</h2><p>Own text {0}</p></div></body>"
    data = [(i, f"http://h.example/{i}", page.format(i), "low") for i in range(9)]
    data += [(20, "http://H.example:80/x", "<nav>m</nav><main><p>a&amp;b<p>c\n d</main><footer>f</footer>", "low"),
             (21, None, None, None), (22, "no url", "", None), (23, None, "<p>x</p>", None)]
    data += [data[0], data[0]]
    d = spark.createDataFrame(data, "page_id long, url string, html string, low string")
    got = collected(html_extract.main_texts(d), "page_id", "url", "text", "n_chars")
    want = [(i, f"http://h.example/{i}", f"Title {i}\nOwn text {i}") for i in range(9)]
    want += [(20, "http://H.example:80/x", "a&b\nc d"), (21, None, ""), (22, "no url", ""), (23, None, "x")]
    want += [want[0], want[0]]
    assert got == Counter((*w, len(w[2])) for w in want)
    assert html_extract.main_texts(d.where("false")).count() == 0


def test_html_extraction_merges_pages_whose_wrappers_have_values_of_their_own(spark):
    page = ("<body class='postid-{0}'><div id='page-{0}'><div class=top>Welcome</div>"
            "<div class=text><h2>Title {0}</h2><p>Own text {0}</p></div></div></body>")
    d = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(9)],
                              "page_id long, url string, html string")
    got = html_extract.main_texts(d)
    assert collected(got, "page_id", "text") == Counter((i, f"Title {i}\nOwn text {i}") for i in range(9))
    assert "FlatMapGroups" not in html_extract.low_branches(d)._jdf.queryExecution().executedPlan().toString()


def test_low_importance_decides_inside_articles_too(spark):
    page = ("<body><article><h1>On every page</h1><p>Own text of page number {0} on this host</p>"
            "<div class='box7'>Buy our new book</div></article></body>")
    shared = "<body><article><p>One article</p><div class='x'>that all pages of the host carry</div></article></body>"
    d = spark.createDataFrame([(i, "http://a/", page.format(i)) for i in range(50)] +
                              [(i, "http://b/", shared) for i in range(50, 56)], "page_id long, url string, html string")
    assert collected(html_extract.main_texts(d), "page_id", "text") == Counter(
        [(i, f"On every page\nOwn text of page number {i} on this host") for i in range(50)] +
        [(i, "One article\nthat all pages of the host carry") for i in range(50, 56)])


def test_a_page_of_thousands_of_levels_costs_no_more_jobs(spark, monkeypatch):
    calls, written = [], html_extract.written
    monkeypatch.setattr(html_extract, "written", lambda df, name: calls.append(name) or written(df, name))
    page = "<body><div class=top>Welcome</div><div class=text><p>Own text {0}</p></div></body>"
    deep = "<body>" + "<div>" * 2000 + "Deep" + "</div>" * 2000 + "</body>"
    d = spark.createDataFrame([(i, "http://h/", page.format(i)) for i in range(9)] + [(9, "http://h/", deep)],
                              "page_id long, url string, html string")
    got = collected(html_extract.main_texts(d), "page_id", "text")
    assert got == Counter([(i, f"Own text {i}") for i in range(9)] + [(9, "Deep")]) and len(calls) < 10


def test_composites_against_recursion(spark):
    import math
    rnd = random.Random(4)

    def branch(level):
        inner = "".join(branch(level + 1) for _ in range(rnd.randrange(1, 3))) if level < 2 else ""
        return f"<div class={rnd.choice('ab')}>{rnd.choice(['x', 'y', ''])}{inner}</div>"
    pages = [(i, f"http://{rnd.choice('hk')}/", f"<body>{branch(0)}</body>") for i in range(200)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    tree = html_extract.site_tree(d)
    got = {(r.host, r.node): r.importance for r in html_extract.composites(tree).collect()}

    kept = {}
    for _, url, html in pages:  # counted here anew: styles, contents and parents of each path
        elements, blocks = html_extract.parse(html)
        host, style, text, parent = url[7:8], {}, {}, {}
        for e in elements:
            style[e.path] = style.get(e.path, "") + "|" + " ".join(e.children)
        for e, line, t in blocks:
            text[e.path] = text.get(e.path, "") + "\n" + t
            parent.update((c.path, a.path) for a, c in zip(line, line[1:], strict=False))
        for n in style:
            k = kept.setdefault((host, n), (Counter(), Counter(), set()))
            k[0][style[n]] += 1
            k[1].update([text[n]] if n in text else [])
            k[2].update([parent[n]] if n in parent else [])

    def mean_entropy(c):
        m = sum(c.values())
        return sum(f / m * math.log(f) for f in c.values()) / math.log(m) if m > 1 else 0.0

    def composite(host, n):
        styles, contents, _ = kept[host, n]
        below = [composite(h, c) for (h, c), k in kept.items() if h == host and n in k[2]]
        own = [1 - mean_entropy(contents)] if contents else []
        if not below:
            return own[0] if own else 1 - mean_entropy(styles)
        keep = html_extract.DAMP ** len(styles)
        mean = (sum(below) + sum(own)) / (len(below) + len(own))
        return max([(1 - keep) * (1 - mean_entropy(styles)) + keep * mean, *below, *own])
    assert set(got) == set(kept) and len({v for v in got.values()}) > 5
    assert all(abs(got[h, n] / 1e9 - composite(h, n)) < 1e-7 for h, n in kept)


@pytest.mark.parametrize("shard", [4096, 20])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    rnd = random.Random(8)
    data = [(i, [rnd.choice([-0.5, 0.25, 1.0, 0.1]) for _ in range(3)]) for i in range(400)]  # many ties
    bad = [(50, None), (1000, [1.0, None, 1.0]), (1001, [1.0, float("nan"), 1.0]), (1050, [float("inf"), 0.0, 0.0]),
           (None, [9.0, 9.0, 9.0]), (1100, [1.0]), (1101, [2.0]), (1150, [5.0, 5.0])]
    data = [r for r in data if r[0] != 50]
    d = spark.createDataFrame(data + bad + data[:5], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in topk.top_k(topk.integer_vectors(d), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data + data[:5]]  # each repeated row is a candidate
    rows += [(1100, [256]), (1101, [512]), (1150, [1280, 1280])]
    want = {}
    for q, x in dict(rows).items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(y) == len(x))[:5]
            if best:
                want[q] = [(r, i, -s) for r, (s, i) in enumerate(best, start=1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.top_k(topk.integer_vectors(d.where("false")), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline(spark, tmp_path, tokenizer):
    """Stage by stage against brute force, on a table of its own."""
    rnd = random.Random(9)
    bad = ["scum", "moron", "idiot", "loser"]
    data, marks = [], []
    base = [r for r in rows(5, 300)]
    for r in base:
        toxic = r[0] is not None and r[0] % 6 == 0 and r[0] < 100 and r[1]
        text = " ".join(w for x in (r[1] or "").split() for w in ([x, rnd.choice(bad)] if toxic and rnd.random() < .3 else [x]))
        data.append((r[0], None if r[1] is None else text, *r[2:]))
        if r[0] is not None:
            marks.append((r[0], 1, int(bool(toxic))))
    spark.createDataFrame(data, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        before, d = d, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert d.columns == before.columns
        seen.append((name, before.collect(), d.collect()))
    (_, start, calm), (_, _, single), (_, _, cut), (_, _, mixed), (_, _, tokens) = seen
    assert len(start) == len(data) and Counter(calm) <= Counter(start)
    fps, groups, _ = components_by_hand([(r.doc_id, r.text) for r in calm])
    assert len(single) == len(set(groups)) and Counter(single) <= Counter(calm)
    texts = [(r.text or "").encode() for r in single]
    assert Counter((r.doc_id, r.text) for r in cut) == Counter(
        (r.doc_id, None if r.text is None else bytes(np.frombuffer(t, np.uint8)[~m]).decode())
        for r, t, m in zip(single, texts, covered(texts, corpus_pipeline.PASSAGE)))
    assert set(mixed) <= set(cut) and max(Counter(mixed).values()) <= 2
    library = tokenizer[1]
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in tokens) == Counter(
        (r.doc_id, len(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(tokens)


def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
