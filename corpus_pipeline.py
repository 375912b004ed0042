"""Corpus pipeline: stages over the documents table, each calling one operator of ragtally.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again
as the next stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragtally.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from ragtally.llm.common import documents, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on these documents and their labels, does not reject."""
    return toxicity.ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (that of the smallest doc_id)."""
    return simhash.survivors(docs)


#: Bytes of a string that counts as repeated: somewhat less than 50 words have.
PASSAGE = 250


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the PASSAGE-byte strings that start more than once; every document stays."""
    return suffix_dedup.deduplicated(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the token ids and of the text they decode to, of each row of the mix."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mix),
    ("byte-level bpe", tokenize),
]

#: No SQL: near-duplicate components, suffix matches and the tokenizer are beyond it; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
