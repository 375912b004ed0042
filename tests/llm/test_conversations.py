"""Operator 13: damage, faults and repairs against a shortest-path search by brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ragtally.llm import conversations, repairs

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        h = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired): Dijkstra over (row, state) with the audit as the second key."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, text = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(text)
        for letter, role in (("u", "user"), ("a", "assistant")):
            if letter in step[state]:
                heapq.heappush(queue, (cost + 3, audit + "I", at, letter, (*text, role + ":")))
        if at < len(rows):
            _, _, role, body = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, text))
            if found[at] in ("", "truncated"):
                more = 3 * (found[at] == "truncated")
                if role[:1] in step[state]:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, role[0], (*text, f"{role}:{body}")))
                for letter, new in (("u", "user"), ("a", "assistant")):
                    if letter in step[state]:
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, letter, (*text, f"{new}:{body}")))


def by_hand(original, rows):
    groups = {r[0]: [] for r in original}
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for conv, of in groups.items():
        of.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        found, turns = faults(of), [r[1] for r in of if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(of, of[1:]))
        cost, audit, text = cheapest(of, found)
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def table(seed, n, longest):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "Why?", " ", "", "Done. ", "end.\n", None, "é. x", "..", "a\nb."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "User", "u"]
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rnd.randint(1, longest)):
            turn += rnd.choice([0, 1, 1, 1, 1, 3])
            body = rnd.choice(texts) if rnd.random() < 0.4 else f"words {rnd.randint(0, 60)}" + rnd.choice([".", "!", "", " ?"])
            role = rnd.choice(roles) if rnd.random() < 0.5 else ["user", "assistant"][turn % 2]
            out.append((conv, None if rnd.random() < 0.03 else turn, role, body))
    out += [(None, 1, "user", "Hi."), (None, 2, "assistant", "So."), (None, None, "system", "S."), (9000, 1, None, None),
            (9001, 1, "user", "x" * 200_000 + "."), (9001, 2, "assistant", "ok."), (9002, None, None, None)]
    out += [(9003, 1, "user", "Same.")] * 30 + [(9003, 2, "assistant", "Same.")] * 7 + [(9003, 3, "user", "Same.")] * 5
    rnd.shuffle(out)
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("seed,n,longest", [(1, 60, 9), (2, 6, 120)])
def test_report_is_that_of_brute_force(spark, seed, n, longest):
    data = table(seed, n, longest)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for c in ("conv", "m", "kind", "block", "size", "first", "place", "mark", "audit", "col"):
        df = df.withColumn(c, F.lit("clash"))
    rows = conversations.damaged(df)
    assert Counter(map(tuple, rows.collect())) == Counter(damaged(data))
    got = conversations.report(df, rows)
    assert got.columns == NAMES
    want = by_hand(data, damaged(data))
    for r in got.collect():
        assert (r["conv_id"], *tuple(r)[1:]) == (r["conv_id"], *want.pop(r["conv_id"]))
    assert not want


def test_repaired_rows(spark):
    data = table(3, 30, 12)
    rows = conversations.repaired(spark.createDataFrame(data, SCHEMA)).collect()
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in data]
    want, got = by_hand(whole, whole), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["place"]):
        got[r["conv_id"]].append(r)
    for conv, w in want.items():
        of = got[conv]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in of).encode()).hexdigest() == w[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in of))
        assert [(r["place"], r["edit"]) for r in of] == [(i, e) for i, e in enumerate(w[6]) if e != "D"]


def test_conversations_without_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, "user", "a."), (2, 1, "user", "b.")], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(df, df.where("conv_id = 2")).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][5:7] == (3, "KI")
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(empty, conversations.damaged(empty)).count() == 0
    assert conversations.repaired(empty).count() == 0


def test_blocks_give_the_same_as_the_whole():
    rnd = random.Random(4)
    for _ in range(300):
        items = [(rnd.choice([1, 1, 1, 2, 5]), rnd.randrange(16)) for _ in range(rnd.randint(1, 40))]
        k = rnd.randint(1, 8)
        blocks = [items[i:i + k] for i in range(0, len(items), k)]
        after, vectors = repairs.FINISH, []
        for b in reversed(blocks):
            vectors.append(after)
            after = repairs.through(repairs.matrix(b), after)
        state, audit = repairs.START, ""
        for i, (b, v) in enumerate(zip(blocks, reversed(vectors))):
            state, edits = repairs.walk(b, v, state, i + 1 == len(blocks))
            audit += "".join(x for x, _, _ in edits)
        whole = repairs.walk(items, repairs.FINISH, repairs.START, True)
        assert state == whole[0] and audit == "".join(x for x, _, _ in whole[1])
        v = repairs.FINISH
        for item in reversed(items):
            v = repairs.before(v, item)
        assert v == after
