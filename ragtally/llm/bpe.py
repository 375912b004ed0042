"""Byte-level BPE encoding and decoding (operator 6).

Words are the matches of the tokenizer's pattern.  A corpus has far fewer
distinct words than words, so only distinct ones are encoded:

1. ``mapInArrow``: documents are packed into compressed blocks, one per batch
   and chunk; a chunk is a share of the documents of about CHUNK_CHARS
   characters, by a hash of the row.
2. Per chunk, the distinct words, as one compressed list for each word bucket
   (a hash of the word).
3. Per bucket, the distinct words of all chunks, as byte arrays: each byte as
   its two-byte token id.
4. Spark higher-order functions encode them: ``aggregate`` folds the ranked
   merges over a word, always joining the leftmost pair of least rank, with
   the rank map as a literal.
5. Per bucket, each chunk's list gets its ids, in the same order; per chunk,
   documents are put together from their words' ids.  Decoding concatenates
   the ids' binary pieces.

The rank map literal is a binary one: an entry (pair of two-byte ids, id of
the joined token) sits in one of two slots given by the pair's CRC (cuckoo
hashing), so a lookup reads at most two entries.  A literal ``map`` would be
scanned from its start at every lookup, and arrays of boxed numbers are slow
to send with every task.

The fold is quadratic in a word's length.  Words of more than LONG_WORD bytes
take the same merges with a heap in step 5 (same ids, tested).

Skew: a chunk holds a bounded share of the text whatever the ids, a frequent
word is one entry per chunk, and no text moves but for the blocks.

Defined results: a null text counts as empty; an empty text has no ids; null
ids stay; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import pickle
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import let as _let
from .common import text_of

CHUNK_CHARS = 16_000_000
LONG_WORD = 256
_LIST = 2048  # words in an array that is encoded at once

# sizes of the two slot functions of the rank table (CRC of the pair modulo these)
_SLOTS = (262_139, 262_133)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file (token bytes -> id), read on the driver."""
    with open(path, "rb") as fh:
        return {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, fh)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the joined bytes, for all ways to cut a token in two tokens."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def _two(i: int) -> bytes:
    return i.to_bytes(2, "big")


def rank_table(pairs: dict[tuple[int, int], int]) -> bytes:
    """The pairs in cuckoo slots of six bytes: pair, id of the joined token.  Empty slots hold id 0xFFFF."""
    slots: list[bytes | None] = [None] * max(_SLOTS)
    for (left, right), rank in pairs.items():
        entry, which = _two(left) + _two(right) + _two(rank), 0
        for _ in range(500):
            s = zlib.crc32(entry[:4]) % _SLOTS[which]
            slots[s], entry = entry, slots[s]
            if entry is None:
                break
            which = 1 if zlib.crc32(entry[:4]) % _SLOTS[0] == s else 0
        else:
            raise ValueError("the rank table is too full")
    return b"".join(x or b"\xff" * 6 for x in slots)


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Encode each word: `words` is array<binary>, a word's bytes as two-byte ids; the result is array<binary>
    with the ids of the merged word, two bytes each."""
    if max(ranks.values()) >= 0xFFFF:
        raise ValueError("ids of up to 65534 fit two bytes")
    edge = F.lit(b"\xff\xfe")  # stands before and after a word; in no pair

    def sub(b: Column, start, length) -> Column:
        return F.substring(b, start if isinstance(start, Column) else F.lit(start),
                           length if isinstance(length, Column) else F.lit(length))

    def encode(table: Column, w: Column) -> Column:
        def rank(pair: Column) -> Column:
            at = [(F.crc32(pair) % F.lit(n)).cast("int") * 6 for n in _SLOTS]
            return (F.when(sub(table, at[0] + 1, 4) == pair, sub(table, at[0] + 5, 2))
                    .when(sub(table, at[1] + 1, 4) == pair, sub(table, at[1] + 5, 2)))

        def step(acc: Column, _: Column) -> Column:
            p, r = acc["p"], acc["r"]

            def merge(new: Column, at: Column) -> Column:  # at: one-based place of the leftmost pair of least rank
                pairs = F.array(F.concat(sub(p, at * 2 - 3, 2), new), F.concat(new, sub(p, at * 2 + 3, 2)))
                return F.struct(
                    F.concat(sub(p, 1, at * 2 - 2), new, sub(p, at * 2 + 3, F.length(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), at - 2), F.transform(pairs, rank),
                             F.slice(r, at + 2, F.size(r))).alias("r"))

            return _let(F.array_min(r), lambda new: F.when(new.isNull(), acc).otherwise(
                _let(F.array_position(r, new).cast("int"), lambda at: merge(new, at))))

        n = F.shiftright(F.length(w), 1)
        start = _let(F.concat(edge, w, edge), lambda p: F.struct(p.alias("p"), F.transform(
            F.transform(F.sequence(F.lit(0), n), lambda i: sub(p, i * 2 + 1, 4)), rank).alias("r")))
        done = F.aggregate(F.sequence(F.lit(2), n), start, step)["p"]
        return F.when(n > 1, _let(done, lambda p: sub(p, 3, F.length(p) - 4))).otherwise(w)

    return _let(F.lit(rank_table(pair_ranks(ranks))),
                lambda table: F.transform(words, lambda w: encode(table, w)))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges, leftmost pair of least rank first, with a heap (for long words)."""
    parts: list[bytes | None] = [bytes([b]) for b in word]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, i + 1) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        if parts[i] is None or after[i] != j or j >= len(parts) or ranks.get(parts[i] + parts[j]) != r:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
            if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, after[i]))
        if before[i] >= 0 and (r := ranks.get(parts[before[i]] + parts[i])) is not None:
            heapq.heappush(heap, (r, before[i], i))
    return [ranks[p] for p in parts if p is not None]


_NARROW = 0x180  # Latin up to Extended-A


def narrow(pattern: str) -> str:
    """The pattern with its Unicode classes written out for characters below _NARROW, for the faster engine."""
    chars = [chr(c) for c in range(_NARROW)]
    classes = {name: "".join(map(re.escape, (c for c in chars if regex.fullmatch(name, c))))
               for name in (r"\p{L}", r"\p{N}", r"\s")}
    out = []
    # bracketed classes as a whole, then single classes; alternatives and quantifiers stay
    for part in re.split(r"(\[[^\]]*\]|\\p\{[LN]\}|\\[sS])", pattern):
        if part == r"\S":
            part = "[^" + classes[r"\s"] + "]"
        elif part in classes:
            part = "[" + classes[part] + "]"
        elif part.startswith("["):
            for name, every in classes.items():
                part = part.replace(name, every)
        out.append(part)
    return "".join(out)


class Splitter:
    """Matches of the pattern; texts of characters below _NARROW take the narrow form (same matches, tested)."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.wide, self.near = regex.compile(pattern).findall, re.compile(narrow(pattern)).findall
        self.far = re.compile(f"[^\x00-{chr(_NARROW - 1)}]").search

    def __reduce__(self):
        return Splitter, (self.pattern,)

    def __call__(self, text: str) -> list[str]:
        return (self.wide if self.far(text) else self.near)(text)


def _packed(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def _unpacked(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, ids and texts) -> one compressed block per batch and chunk."""
    for b in batches:
        chunk = np.asarray(b.column("chunk").to_numpy(zero_copy_only=False))
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        own = [(int(c), np.flatnonzero(chunk == c).tolist()) for c in np.unique(chunk)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in own], pa.int32()),
             pa.array([_packed(([ids[i] for i in at], [texts[i] for i in at])) for _, at in own], pa.binary())],
            names=["chunk", "block"])


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


class _Words:
    """The steps that need the pattern, the ranks or the number of buckets (sent to the tasks)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, buckets: int):
        self.ranks, self.split, self.buckets = ranks, Splitter(pattern), buckets

    def lists(self, words: Iterable[str]) -> dict[int, list[bytes]]:
        """The words by bucket, each list in order; long words are left out."""
        out: dict[int, list[bytes]] = {}
        for w in sorted(x for x in (w.encode() for w in words) if len(x) <= LONG_WORD):
            out.setdefault(zlib.crc32(w) % self.buckets, []).append(w)
        return out

    def dictionary(self, table: pa.Table) -> pa.Table:
        words: set[str] = set()
        for block in table.column("block"):
            for text in _unpacked(block.as_py())[1]:
                words.update(self.split(text))
        lists = self.lists(words)
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(lists), pa.int32()), "bucket": pa.array(list(lists), pa.int32()),
                         "words": pa.array([_packed(v) for v in lists.values()], pa.binary())})

    def distinct(self, table: pa.Table) -> pa.Table:
        words: set[bytes] = set()
        for blob in table.column("words"):
            words.update(_unpacked(blob.as_py()))
        two = [_two(self.ranks[bytes([b])]) for b in range(256)]
        every = [b"".join(map(two.__getitem__, w)) for w in sorted(words)]
        parts = [every[i:i + _LIST] for i in range(0, len(every), _LIST)]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(parts), pa.int32()),
                         "part": pa.array(range(len(parts)), pa.int32()),
                         "words": pa.array(parts, pa.list_(pa.binary()))})

    def answer(self, lists: pa.Table, encoded: pa.Table) -> pa.Table:
        """Ids of each chunk's words in this bucket, in the order of its list."""
        lists_of = [_unpacked(x) for x in _column(lists, "words")]
        every = sorted(set().union(*lists_of))
        ids = [i for _, part in sorted(zip(_column(encoded, "part"), _column(encoded, "ids"), strict=True)) for i in part]
        of = dict(zip(every, ids, strict=True))
        return pa.table({"chunk": lists.column("chunk"), "bucket": lists.column("bucket"),
                         "ids": pa.array([_packed([of[w] for w in words]) for words in lists_of], pa.binary())})

    def documents(self, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """doc_id, ids (32-bit, little-endian) and decoded bytes of a chunk's documents."""
        pieces = {rank: token for token, rank in self.ranks.items()}
        doc_ids, places = [], []
        place: defaultdict[str, int] = defaultdict()  # words by first appearance
        place.default_factory = place.__len__
        for block in blocks.column("block"):
            ids, texts = _unpacked(block.as_py())
            doc_ids += ids
            places += [array("i", map(place.__getitem__, self.split(t))) for t in texts]
        lists, of = self.lists(place), {}
        for bucket, blob in zip(_column(answers, "bucket"), _column(answers, "ids"), strict=True):
            of.update(zip(lists.get(bucket, ()), _unpacked(blob), strict=True))
        encoded, decoded = [], []
        for w in place:
            raw = w.encode()
            ids = array("H", of[raw]) if raw in of else None
            if ids is None:
                ids = array("I", merge_word(raw, self.ranks))
            elif sys.byteorder == "little":  # the fold's ids are big-endian
                ids.byteswap()
            encoded.append(np.array(ids, dtype="<u4").tobytes())
            decoded.append(b"".join(map(pieces.__getitem__, ids)))
        ids_out = [b"".join(map(encoded.__getitem__, at)) for at in places]
        decoded_out = [b"".join(map(decoded.__getitem__, at)) for at in places]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids_out, pa.binary()),
                         "decoded": pa.array(decoded_out, pa.binary())})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (32-bit little-endian numbers, binary) and decoded (the ids' pieces joined, binary)."""
    ship_package(docs.sparkSession)
    total = docs.agg(F.sum(F.length(text_of()))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_CHARS))
    w = _Words(ranks, pattern, buckets=max(1, chunks))
    chunk = F.pmod(F.xxhash64("doc_id", text_of()), F.lit(chunks)).cast("int")
    blocks = docs.select("doc_id", chunk.alias("chunk"), text_of().alias("text")).mapInArrow(
        _blocks, "chunk int, block binary")
    lists = blocks.groupBy("chunk").applyInArrow(lambda t: w.dictionary(t), "chunk int, bucket int, words binary")
    distinct = lists.groupBy("bucket").applyInArrow(lambda t: w.distinct(t), "bucket int, part int, words array<binary>")
    encoded = distinct.select("bucket", "part", fold_words(F.col("words"), ranks).alias("ids"))
    answers = lists.groupBy("bucket").cogroup(encoded.groupBy("bucket")).applyInArrow(
        lambda a, b: w.answer(a, b), "chunk int, bucket int, ids binary")
    return blocks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda a, b: w.documents(a, b), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    e = encode(docs, ranks, pattern)
    return e.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
