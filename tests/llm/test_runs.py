"""Operator 12: runs against brute force, the damage, the collapsed texts and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtally.llm import periods, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(w, least=periods.LEAST_LENGTH, exponent=periods.EXPONENT):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                s = w[i:j + q]
                if not any(s[r:] == s[:-r] for r in range(1, q)):
                    out.add((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out)


def sequence(rnd):
    w = []
    while len(w) < rnd.randint(20, 160):
        part = [rnd.choice("ab" if rnd.random() < 0.5 else "abcdefghijk").encode() for _ in range(rnd.randint(1, 12))]
        w += (part * rnd.randint(1, 9))[:rnd.randint(1, len(part) * 9)]
    return w


def test_runs_are_those_of_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        w = sequence(rnd)
        assert periods.runs(w) == by_hand(w)


@pytest.mark.parametrize("least,exponent", [(4, 2), (6, 2), (9, 3)])
def test_automaton_alone_finds_squares_and_cubes(least, exponent):
    rnd = random.Random(least)
    for _ in range(200):
        w = sequence(rnd)
        ids = np.array([x[0] for x in w], dtype=np.int64)
        assert sorted(periods.runs_within(ids, 0, len(w), least, exponent)) == by_hand(w, least, exponent)


def test_link_cut_paths_hold_the_last_ends():
    rnd = random.Random(2)
    for _ in range(50):
        w, a = [x[0] for x in sequence(rnd)], periods._Automaton()
        for i, word in enumerate(w):
            met = a.append(word, i, 1)
            before = i
            for end, size in met:  # ends go back as lengths shrink, and each length's last end is right
                assert end < i and size <= before + 1
                tail = w[i - size + 1:i + 1]
                assert max(e for e in range(size - 1, i) if w[e - size + 1:e + 1] == tail) == end
                before = size


def test_very_long_texts():
    for w in ([b"a"] * 60_000, [b"a", b"b", b"c"] * 20_000):
        assert periods.runs(w) == [(0, 60_000, len(set(w)))]
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2][:])
    w = [bytes([c]) for c in fib[-1]]
    found = periods.runs(w)
    assert found and all(length >= max(24, 3 * q) for _, length, q in found)


def rows():
    rnd = random.Random(3)
    out = [(i, " \n"[i % 2].join(x.decode() for x in sequence(rnd)), "en", "s", 1) for i in range(150)]
    out += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \t\x0b\n", "en", "s", 1), (203, "one", "en", "s", 1),
            (204, "é ü x " * 30, "en", "s", 1), (205, "w " * 25_000, "en", "s", 1), (None, "x y " * 40, "en", "s", 1),
            (None, None, None, None, None)]
    return out + [out[3], out[3], out[-2]]


def damaged(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def wanted(data):
    out = Counter()
    for doc_id, text, *_ in data:
        w = damaged(doc_id, text)
        found = by_hand(w) if len(w) < 1000 else periods.runs(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        top = (None,) * 4
        if found:
            best = found[0]
            for r in found:
                best = r if r[1] * best[2] > best[1] * r[2] else best
            top = (*best, best[1] * 1000 // best[2])
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_digests_of_damaged_documents(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    for c in ("runs", "start", "length", "period", "collapsed", "n_words", "__text"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = runs.digests(runs.periodic(runs.damaged(docs)))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {f.dataType.simpleString() for f in got.schema.fields[:6]} == {"bigint"}
    assert Counter(tuple(r)[:8] for r in got.collect()) == wanted(data)
    assert sum(n for k, n in wanted(data).items() if k[1]) > 20


def test_without_runs_keeps_rows_and_columns(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).withColumn("runs", F.lit(7)).withColumn("collapsed", F.lit("clash"))
    out = runs.without_runs(docs)
    assert out.columns == docs.columns and out.count() == len(data)
    want = Counter()
    for doc_id, text, *_ in data:
        w = (text or "").encode().split()
        found = periods.runs(w)
        want[doc_id, b" ".join(periods.collapsed(w, found)).decode() if found else text] += 1
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert {(r["runs"], r["collapsed"]) for r in out.collect()} == {(7, "clash")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.digests(runs.periodic(runs.damaged(empty))).count() == 0 and runs.without_runs(empty).count() == 0
