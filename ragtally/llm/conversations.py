"""Conversation structure repair (operator 13).

Rows of a conversation are taken by turn (nulls first; equal turns by role, then by the MD5 of the text).  A row's
first fault counts: blank, duplicate (role and text of an earlier row), truncated.  The cheapest edits (keep 0, relabel
to user or assistant 3, remove 4, add 3; blank and duplicate rows are removed, a truncated row that stays adds 3) give
the role initials `(s?(ua)+)?`; of equally cheap audits the ASCII-least is taken.

The search is the square-root checkpointed one of :mod:`ragtally.llm.repairs`, as Spark jobs, so no task needs a whole
conversation: rows are numbered by a range sort and dealt to blocks of about the square root of their conversation's
length.  Blocks are measured apart (a matrix each); a conversation's matrices (again about the square root of its
length) give the cost vectors at the checkpoints; each block recomputes its own vectors and tells where the four
possible states lead; from these follow each block's state, and the blocks write their edits.  Equal rows of a turn
travel as one row with a count, and texts only join the rows that stay.

Defined results: a null conv_id is a conversation of its own; null roles and texts are one space; a null turn comes
before all others; repeated rows are duplicates; very long texts are processed whole; a conversation without rows has
an empty audit; an empty table gives an empty result; columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import repairs
from .common import numbered, written

_NO_VALUE = " "
_WORD_CHARACTER = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, nulls in role and text one space, damaged by crc32('conv_id:turn') % 20 (nulls
    one space): 0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NO_VALUE))
    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("h") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def _conv() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(_NO_VALUE)).alias("conv")


def _rows(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and mark (MD5 of the text)."""
    text = F.coalesce(F.col("text"), F.lit(_NO_VALUE))
    return rows.select(_conv(), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(_NO_VALUE)).alias("role"),
                       text.alias("text"), F.unhex(F.md5(text)).alias("mark"))


def _order() -> Column:
    """The turn as a value that nulls can be compared by."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"))


def items(rows: DataFrame) -> DataFrame:
    """One row for the equal rows of a turn: conv, turn, role, mark, m (their number), kind, n (place in the order of
    all conversations), block (place in the conversation by about the square root of its length)."""
    found = _rows(rows)
    found = found.select("conv", "turn", "role", "mark", (~F.col("text").rlike(_WORD_CHARACTER)).alias("blank"),
                         (~F.col("text").rlike(_ENDED)).alias("cut"))
    equal = written(found.groupBy("conv", "turn", "role", "mark", "blank", "cut").agg(F.count("*").alias("m")), "repair-rows")
    firsts = written(equal.groupBy("conv", "role", "mark").agg(F.min(_order()).alias("first")), "repair-firsts")
    fault = F.when(F.col("blank"), repairs.BLANK).when(_order() != F.col("first"), repairs.DUPLICATE).when(
        F.col("cut"), repairs.TRUNCATED).otherwise(repairs.NONE)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", repairs.SYSTEM).when(initial == "u", repairs.USER).when(
        initial == "a", repairs.ASSISTANT).otherwise(repairs.OTHER)
    coded = equal.join(firsts, ["conv", "role", "mark"]).select("conv", "turn", "role", "mark", "m", (role + 4 * fault).cast("long").alias("kind"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]
    placed = written(numbered(coded, order, "n"), "repair-placed")
    sizes = written(placed.groupBy("conv").agg(F.min("n").alias("first"), F.count("*").alias("size")), "repair-sizes")
    return placed.join(sizes, "conv").select(
        "conv", "turn", "role", "mark", "m", "kind", "n",
        F.floor((F.col("n") - F.col("first")) / F.ceil(F.sqrt("size"))).alias("block"))


def _pairs(values: list) -> list[repairs.Item]:
    return [(x["m"], x["kind"]) for x in values]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_pairs(x) for x in b.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("block"), pa.array([repairs.matrix(x) for x in found], pa.list_(pa.int64())),
             pa.array([repairs.out_of_order(x) for x in found], pa.int64()),
             pa.array([x[0][1] & 3 for x in found], pa.int64()), pa.array([x[-1][1] & 3 for x in found], pa.int64())],
            names=["conv", "block", "matrix", "illegal", "first", "last"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost of a conversation, its rows out of order, and the costs after each of its blocks."""
    for b in batches:
        costs, illegal, vectors = [], [], []
        for blocks in b.column("blocks").to_pylist():
            after, back = repairs.FINISH, []
            for x in reversed(blocks):
                back.append(list(after))
                after = repairs.through(x["matrix"], after)
            costs.append(after[repairs.START])
            vectors.append(back[::-1])
            illegal.append(sum(x["illegal"] for x in blocks) + sum(
                (x["last"], y["first"]) not in repairs.IN_ORDER for x, y in zip(blocks, blocks[1:])))
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()),
             pa.array(vectors, pa.list_(pa.list_(pa.int64())))], names=["conv", "cost", "illegal", "vectors"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each of the four states leads, and by how many edits."""
    for b in batches:
        ends, counts = [], []
        for found, after in zip(b.column("items").to_pylist(), b.column("after").to_pylist(), strict=True):
            of = [repairs.walk(_pairs(found), tuple(after), s, False) for s in range(4)]
            ends.append([state for state, _ in of])
            counts.append([sum(len(letters) for letters, _, _ in edits) for _, edits in of])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(ends, longs), pa.array(counts, longs)],
                                         names=["conv", "block", "ends", "counts"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before each block of a conversation, and the number of edits before it."""
    kind = pa.list_(pa.struct([("state", pa.int64()), ("place", pa.int64()), ("last", pa.bool_())]))
    for b in batches:
        out = []
        for blocks in b.column("blocks").to_pylist():
            state, place, of = repairs.START, 0, []
            for i, x in enumerate(blocks):
                of.append({"state": state, "place": place, "last": i + 1 == len(blocks)})
                state, place = x["ends"][state], place + x["counts"][state]
            out.append(of)
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(out, kind)], names=["conv", "starts"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's part of the audit, and its rows that stay or come: place, letter, n (null: added), given (new role or null)."""
    kind = pa.list_(pa.struct([("place", pa.int64()), ("edit", pa.string()), ("n", pa.int64()), ("given", pa.string())]))
    names = {repairs.USER: "user", repairs.ASSISTANT: "assistant"}
    for b in batches:
        audits, rows = [], []
        for found, after, start in zip(*[b.column(c).to_pylist() for c in ("items", "after", "start")], strict=True):
            _, edits = repairs.walk(_pairs(found), tuple(after), start["state"], start["last"])
            place, of = start["place"], []
            for letters, at, state in edits:
                if letters[0] != "D":
                    of.append({"place": place, "edit": letters, "n": found[at]["n"] if at >= 0 else None,
                               "given": None if letters == "K" else names[state]})
                place += len(letters)
            audits.append("".join(letters for letters, _, _ in edits))
            rows.append(of)
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(audits, pa.string()), pa.array(rows, kind)],
                                         names=["conv", "block", "audit", "rows"])


def plan(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From :func:`items`: conversations (conv, cost, illegal) and edits by block (conv, block, audit, rows)."""
    ship_package(found.sparkSession)
    in_order = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    blocks = written(found.groupBy("conv", "block").agg(in_order("n", "m", "kind").alias("items")), "repair-blocks")
    measured = blocks.mapInArrow(_measure, "conv string, block long, matrix array<bigint>, illegal long, first long, last long")
    costs = measured.groupBy("conv").agg(in_order("block", "matrix", "illegal", "first", "last").alias("blocks")).mapInArrow(
        _checkpoints, "conv string, cost long, illegal long, vectors array<array<bigint>>")
    costs = written(costs, "repair-checkpoints")
    after = costs.select("conv", F.posexplode("vectors").alias("block", "after"))
    blocks = written(blocks.join(after.withColumn("block", F.col("block").cast("long")), ["conv", "block"]), "repair-blocks")
    ends = blocks.mapInArrow(_ends, "conv string, block long, ends array<bigint>, counts array<bigint>")
    starts = ends.groupBy("conv").agg(in_order("block", "ends", "counts").alias("blocks")).mapInArrow(
        _starts, "conv string, starts array<struct<state:bigint,place:bigint,last:boolean>>")
    starts = starts.select("conv", F.posexplode("starts").alias("block", "start"))
    edits = blocks.join(starts.withColumn("block", F.col("block").cast("long")), ["conv", "block"]).mapInArrow(
        _edits, "conv string, block long, audit string, rows array<struct<place:bigint,edit:string,n:bigint,given:string>>")
    return costs.select("conv", "cost", "illegal"), written(edits, "repair-edits")


def _repaired(rows: DataFrame, found: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, place (in the audit), edit, turn, role and text of the rows that stay or come."""
    lines = edits.select("conv", F.explode("rows").alias("r")).select("conv", "r.*")
    texts = _rows(rows).select("conv", F.coalesce(F.col("turn").cast("string"), F.lit(_NO_VALUE)).alias("when"), "role", "mark", "text")
    texts = texts.dropDuplicates(["conv", "when", "role", "mark"])
    stay = lines.where("n is not null").join(found.select("n", "turn", "role", "mark"), "n")
    stay = stay.withColumn("when", F.coalesce(F.col("turn").cast("string"), F.lit(_NO_VALUE))).join(
        texts, ["conv", "when", "role", "mark"]).select(
        "conv", "place", "edit", "turn", F.coalesce("given", "role").alias("role"), "text")
    return stay.union(lines.where("n is null").select(
        "conv", "place", "edit", F.lit(None).cast("long").alias("turn"), F.col("given").alias("role"), F.lit("").alias("text")))


def _conv_id(conversations: DataFrame) -> Column:
    kind = conversations.schema["conv_id"].dataType
    return F.when(F.col("conv") != _NO_VALUE, F.col("conv")).cast(kind).alias("conv_id")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (order within the conversation), edit (K, R or I), turn (null: added), role, text."""
    found = written(items(rows), "repair-items")
    _, edits = plan(found)
    return _repaired(rows, found, edits).select(_conv_id(rows), "place", "edit", "turn", "role", "text")


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; only the running digest is held."""
    now, digest = None, hashlib.sha256()
    for b in batches:
        done: list[tuple[str, str]] = []
        for conv, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist(), strict=True):
            if conv == now:
                digest.update(b"\n")
            else:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            digest.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())],
                                         names=["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`, about its rows in `rows`: gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 (of the repaired `role:text`, one a line)."""
    found = written(items(rows), "repair-items")
    costs, edits = plan(found)
    fault, m = F.floor(F.col("kind") / 4), F.col("m")
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    again = F.when(fault == repairs.DUPLICATE, m).when(fault != repairs.BLANK, m - 1).otherwise(0)
    faults = found.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("reach"),
        total(F.when(fault == repairs.BLANK, m).otherwise(0), "blank"), total(again, "duplicate"),
        total(F.when(fault == repairs.TRUNCATED, 1).otherwise(0), "truncated"))
    turns = found.select("conv", "turn").distinct().groupBy("conv").agg(F.count("turn").alias("turns"))
    audits = edits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("parts")).select(
        "conv", F.array_join("parts.audit", "").alias("audit"))
    lines = _repaired(rows, found, edits).select("conv", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = lines.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_hash_lines, "conv string, repaired_sha256 string")
    out = conversations.select(_conv()).distinct()
    for part in (faults, turns, costs, audits, hashes):
        out = out.join(part, "conv", "left")
    count = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return out.select(
        _conv_id(conversations), count(F.col("reach") - F.col("turns"), "gaps"), *[count(F.col(c), c) for c in (
            "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
