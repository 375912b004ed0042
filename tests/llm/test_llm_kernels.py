"""The operators' Spark-free parts against brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
import regex
import tiktoken
import xxhash

from ragtally.llm import anchors, bpe, html_extract, langid, simhash, substring, suffix_dedup, topk, toxicity


def covered(sequences, size):
    counts = Counter(s[i:i + size] for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        mark = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - size + 1):
            if counts[s[i:i + size]] > 1:
                mark[i:i + size] = True
        out.append(mark)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_column_construction_finds_what_brute_force_finds(seed):
    rnd = random.Random(seed)
    alphabet = [b"ab", b"abcdefgh ", bytes(range(256))][seed % 3]
    draw = lambda n: bytes(rnd.choice(alphabet) for _ in range(n))
    passages = [draw(rnd.randint(300, 1200)) for _ in range(3)] + [b"a" * 900]
    texts = []
    for _ in range(6):
        t = draw(rnd.randint(0, 700))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 3)
            t += p[a:a + rnd.randint(100, 1200)] + draw(rnd.randint(0, 300))
        texts.append(t)
    found = [suffix_dedup._anchors(t) for t in texts]
    often = Counter(int(x) for f in found for x in f[0])
    rows = sorted((int(h), i, int(a), int(p - a), t[a:e + suffix_dedup.SIZE])
                  for i, (t, f) in enumerate(zip(texts, found)) for h, p, a, e in zip(*f) if often[int(h)] > 1)
    got = [np.zeros(len(t), dtype=bool) for t in texts]
    if rows:
        h = np.array([r[0] for r in rows], dtype=np.uint64)
        group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        first, last = suffix_dedup.column_matches([r[4] for r in rows], np.array([r[3] for r in rows]), group)
        for r, a, e in zip(rows, first, last):
            if a <= e:
                got[r[1]][r[2] + r[3] + a:r[2] + r[3] + e + suffix_dedup.SIZE] = True
    assert all((a == b).all() for a, b in zip(got, covered(texts, suffix_dedup.SIZE)))


def test_window_anchors_are_the_least_and_cover_all_windows():
    grams = np.array([random.Random(3).randint(0, 9) for _ in range(200)], dtype=np.uint64) << np.uint64(40)
    place, first, last = anchors.window_anchors(grams, 7)
    assert first[0] == 0 and last[-1] == 200 - 7 and (first[1:] == last[:-1] + 1).all()
    for p, a, e in zip(place, first, last):
        for s in range(a, e + 1):
            assert p == s + int(np.argmin(grams[s:s + 7]))


def test_merged_intervals():
    a, e = anchors.merged(np.array([5, 0, 9, 20]), np.array([8, 3, 12, 22]))
    assert a.tolist() == [0, 5, 9, 20] and e.tolist() == [3, 8, 12, 22]
    a, e = anchors.merged(np.array([5, 0, 3]), np.array([8, 3, 5]))
    assert (a.tolist(), e.tolist()) == ([0], [8])


def test_cut_text_keeps_whole_characters():
    text = "aé€b"  # 1 + 2 + 3 + 1 bytes
    assert suffix_dedup.cut_text(text, np.array([2]), np.array([5])) == text
    assert suffix_dedup.cut_text(text, np.array([1]), np.array([4])) == "a€b"
    assert suffix_dedup.cut_text(text, np.array([0]), np.array([7])) == ""


def test_word_hashes_follow_words():
    text = "a b  c\tA\x0bd \n a b"
    words = text.encode().split()
    h = substring.word_hashes(text.encode())
    assert len(h) == len(words)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    assert len(substring.word_hashes(b"")) == len(substring.word_hashes(b" \n")) == 0


def test_fingerprint_by_definition():
    rnd = random.Random(2)
    for n in (0, 1, 3, 4, 5, 60):
        text = " \n".join(rnd.choice(["Ab", "cÄ", "x", "y", "zz"]) for _ in range(n))
        tokens = text.encode().lower().split()
        shingles = [b" ".join(tokens[i:i + 4]) for i in range(max(1, len(tokens) - 3))] if tokens else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == 0


def test_linked_is_a_forest_of_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ np.uint64(1 << int(rng.integers(64))) for _ in range(6)] + [base]))
    x = x[np.argsort(np.bitwise_count(x), kind="stable")]

    def roots(edges):
        parent = {int(v): int(v) for v in x}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v
        for a, b in edges:
            parent[find(int(a))] = find(int(b))
        return {frozenset(v for v in parent if find(v) == r) for r in {find(v) for v in parent}}
    every = [(a, b) for i, a in enumerate(x) for b in x[i + 1:] if int(a ^ b).bit_count() <= 4]
    assert roots(zip(*simhash.linked(x, None))) == roots(every)
    u, v = simhash.linked(x[:100], x[100:])
    assert all(int(a ^ b).bit_count() >= 0 for a, b in zip(u, v)) and len(u) < len(x)


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_and_heap_merges_equal_the_library(tokenizer):
    ranks, library = tokenizer
    rnd = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x180e, 0x2003, 0x200b, 0x2028, 0x3000, 0x1F600, 0x660, 0x4E00, 0x301]]
    pool += ["the ", "ing", "'s", "'re", " ", "\n", "\t", "\x1c", "\x85", "\xa0"] * 20
    find = regex.compile(public_tokenizers.PATTERN).findall
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    split = bpe.Splitter(public_tokenizers.PATTERN)
    for t in [*texts, *(t.encode("ascii", "ignore").decode() for t in texts), *(chr(c) + " a1" + chr(c) + chr(c) for c in range(0x200))]:
        assert split(t) == find(t)
    for t in [*texts, "a" * 3000 + " " * 2000 + "é" * 500, ""]:
        assert [i for w in find(t) for i in bpe.merge_word(w.encode(), ranks)] == library.encode_ordinary(t)


def test_ball_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    low = np.iinfo(np.int64).min
    for case in range(12):
        n, d = int(rng.integers(1, 500)), int(rng.integers(1, 9))
        x = rng.integers(-5, 6, size=(n, d)) if case % 2 else rng.integers(-10 ** 10, 10 ** 10, size=(n, d)) // 10 ** (case % 7)
        x = x if float(np.abs(x).max()) ** 2 * d < 2 ** 63 else x // 10 ** 4
        ids = rng.permutation(2 * n)[:n].astype(np.int64)
        tree = topk.BallTree(ids, x, 8)
        s, v = tree.search(ids[:30], x[:30], np.full(min(n, 30), low))
        for j in range(min(n, 30)):
            want = sorted((-int(a), int(b)) for a, b in zip(x @ x[j], ids) if b != ids[j])[:5]
            assert [(-int(a), int(b)) for a, b in zip(s[j], v[j]) if b != topk._NONE] == want
        again, _ = tree.search(ids[:30], x[:30], s[:, -1].copy())
        assert (again == s).all()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad big">Buy</div>
<article><header><h1>Head &amp;  line</h1></header><p><b>One <mark>two</mark>
 three<br><p>Four&nbsp;&#8364; 1 < 2</p><form><input name=q>Find</form><ul><li>a<li>b</ul>
<div class="comment-list"><p>Reader</p></div><aside>Side</aside></article><footer>&copy; host</footer>"""


def test_extract_one_page():
    assert html_extract.extract(PAGE) == "Head & line\nOne two three\nFour € 1 < 2\na\nb"
    assert html_extract.extract("") == "" and html_extract.extract("plain  text") == "plain text"
    assert html_extract.extract("<p>a</p><p>b") == "a\nb"


@pytest.mark.parametrize("page, text", [
    ("<body class='has-sidebar menu-closed header-fixed'><article><p>Text</p></article></body>", "Text"),
    ("<body class='single sidebar'><p>Text</p></body>", "Text"),
    ("<article class='post comments-open'><p>Text</p></article>", "Text"),
    ("<article><div class='entry-header'><h1>Head</h1></div><p>Text</p></article>", "Head\nText"),
    ("<article><div class='long-form'><p>Text</p></div><div class='ad-free'><p>More</p></div></article>", "Text\nMore"),
    ("<div id='content-with-sidebar'><p>Text</p></div><div class='site-footer'>f</div>", "Text"),
    ("<div class='related'><article><p>Text</p></article></div>", "Text"),
    ("<article><p>Text</p></article><div class='related'><article><p>Other</p></article></div>", "Text"),
    ("<article><h2 class='notice'>Head</h2><p>Text</p><div class='notice'>n</div></article>", "Head\nText"),
    ("<article><p>Text</p><div id='ad-2'>a</div><div class='x comments-area'>c</div></article>", "Text")])
def test_names_say_what_a_branch_is_only_as_a_whole(page, text):
    assert html_extract.extract(page) == text


def test_low_importance_branches_go_where_no_article_says_otherwise():
    def nodes(pages):
        import pyarrow as pa
        batch = pa.RecordBatch.from_pydict({"host": ["h"] * len(pages), "html": pages})
        return [r for b in html_extract._nodes(iter([batch])) for r in b.to_pylist()]
    pages = [f"<body><div class=top>Same on all</div><div class=text><p>Own text {i}</p></div></body>" for i in range(8)]
    rows = nodes(pages)
    content = {}
    for r in rows:
        if r["kind"] == 1:
            content.setdefault(r["node"], []).append(r["value"])
    same = [n for n, v in content.items() if len(set(v)) == 1]
    assert len(same) == 1
    low = frozenset(same)
    assert html_extract.extract(pages[3], low) == "Own text 3"


def test_languages_and_und():
    rnd = random.Random(1)
    words = {"en": "the and of with from".split(), "de": "der und nicht mit aus".split(),
             "fr": "le et avec pour dans".split(), "es": "el y con para en".split()}
    make = lambda a: " ".join(rnd.choice(words[a]) for _ in range(30))
    langs = [a for a in words for _ in range(20)]
    x = np.array([langid.features(make(a)) for a in langs])
    model = langid.Model(x, langs)
    assert model.families == ["germanic", "romance"] and set(model.pairs) == {("de", "en"), ("es", "fr")}
    got = model.predict([make(a) for a in langs] + [None, "", " 12 !", "a"])
    assert [g[0] for g in got[:-4]] == langs and [g for g in got[-4:-1]] == [("und", 1.0)] * 3
    assert all(0 <= s <= 1 for _, s in got)
    assert langid.Model(np.zeros((0, langid.FEATURES), np.float32), []).predict(["text"]) == [("und", 1.0)]


def test_toxicity_curve_and_values():
    values = np.array([0.0] * 50 + [0.1] * 20)
    slope, middle = toxicity.fit_curve(values, np.array([0] * 50 + [1] * 20))
    assert slope > 0 and 0 < middle < 0.1
    assert toxicity.fit_curve(values, np.zeros(70)) is None
    bucket = toxicity._buckets(toxicity.expressions("Scum!"))
    model = toxicity.Model(bucket, np.array([4.0]))
    assert model.value("you SCUM, you") == pytest.approx(4 / 3) and model.value("") == 0.0


def test_toxicity_counts_words_of_very_long_texts():
    row = pa.record_batch({"doc_id": [1], "text": ["plain " * 700_000 + "moron"]})
    f = next(toxicity._features(iter([row])))
    f = pa.record_batch({"toxic": [1], "copies": [1]} | {c: f.column(c) for c in ("n", "buckets", "counts")})
    counts = next(toxicity._sums(iter([f])))
    assert counts.num_rows == 2 and min(counts.column("toxic").to_pylist()) > 0


def test_toxicity_expressions_share_no_slots():
    # more expressions than 2^20 slots
    rows = pa.record_batch({"doc_id": [1, 2], "text": ["scum", " ".join(f"w{i}" for i in range(2_000_000))]})
    f = next(toxicity._features(iter([rows])))
    f = pa.record_batch({"toxic": [1, 0], "copies": [1, 1]} | {c: f.column(c) for c in ("n", "buckets", "counts")})
    counts = pa.Table.from_batches(toxicity._sums(iter([f]))).to_pydict()
    assert len(set(counts["bucket"])) == 2_000_001
    scum = toxicity._buckets(toxicity.expressions("scum"))[0]
    assert [t for b, t in zip(counts["bucket"], counts["toxic"]) if t] == [toxicity.UNIT]
    assert [o for b, o in zip(counts["bucket"], counts["ordinary"]) if b == scum] == [0]


def test_toxicity_counts_each_word_before_a_word_once():
    packed = zstandard.ZstdCompressor().compress
    rows = pa.record_batch({"toxic": [0, 1], "packed": [packed(b"a b a b"), packed(b"c b!")]})
    found = pa.Table.from_batches(toxicity._contexts(iter([rows])))
    a, b, c = toxicity._buckets(toxicity.expressions("a b c")).tolist()
    assert sorted(zip(*found.to_pydict().values())) == sorted([(a, 0), (b, a), (a, b), (c, 0), (b, c)])
    assert toxicity._discounts([(0, 2, 2), (toxicity.STEPS, 1, 2)], 4, [0.75, 1.0]) == pytest.approx([1, 2], rel=0.05)
