"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, conversations, html_extract, langid, minhash, mixing, quality, runs, simhash, substring,
               suffix_dedup, topk, toxicity)
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings in all documents."""
    return suffix_dedup.reduced(documents(spark, sf_dir))


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules over all documents."""
    return quality.judge(documents(spark, sf_dir))


@register
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to the sources' target weights."""
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source")


@register
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows in all documents."""
    return substring.reduced(documents(spark, sf_dir))


@register
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and back."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@register
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


@register
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@register
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose vec_id is divisible by 50."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@register
def op11_minhash_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are 80 per cent alike."""
    return minhash.components(documents(spark, sf_dir))


@register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them made periodic."""
    return runs.digests(runs.periodic(runs.damaged(documents(spark, sf_dir))))


@register
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least edits that repair all conversations, a fifth of whose rows are damaged."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


ORACLE["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) r(k) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
        len(list_distinct(list_filter(string_split(t, chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_unique,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
g AS (SELECT *, n_lines - n_unique AS n_dup_lines,
        n_symbols * 1000000 // greatest(word_chars, 1) AS symbols,
        (n_lines - n_unique) * 1000000 // greatest(n_lines, 1) AS lines,
        n_repeat_words * 1000000 // greatest(n_words, 1) AS repeats,
        word_chars * 1000000 // greatest(n_words, 1) AS word_length,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
r AS (SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 6, 0)::BIGINT) << greatest(length(bin(v)) - 6, 0)::BIGINT AS b
      FROM (SELECT lang, source, unnest(['symbols', 'lines', 'repeats', 'word_length']) AS ratio,
              unnest([symbols, lines, repeats, word_length]) AS v FROM g WHERE NOT base_failed)),
u AS (SELECT * FROM (VALUES ('symbols', 90), ('lines', 99), ('repeats', 99), ('word_length', 75)) t(ratio, tail)),
s2 AS (SELECT *, count(*) OVER (PARTITION BY lang, source, ratio) AS n,
         row_number() OVER (PARTITION BY lang, source, ratio ORDER BY b) AS k FROM r),
s1 AS (SELECT *, count(*) OVER (PARTITION BY lang, ratio) AS n,
         row_number() OVER (PARTITION BY lang, ratio ORDER BY b) AS k FROM r),
s0 AS (SELECT *, count(*) OVER (PARTITION BY ratio) AS n, row_number() OVER (PARTITION BY ratio ORDER BY b) AS k FROM r),
q AS (SELECT 2 AS level, lang, source, ratio, n, b, k, tail FROM s2 JOIN u USING (ratio)
      UNION ALL SELECT 1, lang, NULL, ratio, n, b, k, tail FROM s1 JOIN u USING (ratio)
      UNION ALL SELECT 0, NULL, NULL, ratio, n, b, k, tail FROM s0 JOIN u USING (ratio)),
t AS (SELECT level, lang, source, ratio, max(n) AS n, min(CASE WHEN 100 * k >= 25 * n THEN b END) AS q1,
        min(CASE WHEN 100 * k >= 75 * n THEN b END) AS q3, min(CASE WHEN 100 * k >= tail * n THEN b END) AS hi
      FROM q GROUP BY level, lang, source, ratio),
own AS (SELECT *, greatest(q3 + 3 * greatest(q3 - q1, q3 // 32), hi) + 1 AS top, q1 - 3 * greatest(q3 - q1, q3 // 32) AS low
        FROM t),
o AS (SELECT level, lang, source, ratio, n, top + top // 32 AS high, low FROM own),
l AS (SELECT a.lang, a.ratio, floor((a.n::DOUBLE * a.high + 50.0::DOUBLE * w.high) / (a.n + 50)::DOUBLE)::BIGINT AS high,
        floor((a.n::DOUBLE * a.low + 50.0::DOUBLE * w.low) / (a.n + 50)::DOUBLE)::BIGINT AS low
      FROM o a JOIN o w ON a.level = 1 AND w.level = 0 AND a.ratio = w.ratio),
m AS (SELECT a.lang, a.source, a.ratio, floor((a.n::DOUBLE * a.high + 50.0::DOUBLE * l.high) / (a.n + 50)::DOUBLE)::BIGINT AS high,
        floor((a.n::DOUBLE * a.low + 50.0::DOUBLE * l.low) / (a.n + 50)::DOUBLE)::BIGINT AS low
      FROM o a JOIN l ON a.level = 2 AND a.ratio = l.ratio AND a.lang IS NOT DISTINCT FROM l.lang),
lim AS (SELECT lang, source, max(CASE WHEN ratio = 'symbols' THEN high END) AS symbols_high,
        max(CASE WHEN ratio = 'lines' THEN high END) AS lines_high,
        max(CASE WHEN ratio = 'repeats' THEN high END) AS repeats_high,
        max(CASE WHEN ratio = 'word_length' THEN high END) AS length_high,
        max(CASE WHEN ratio = 'word_length' THEN low END) AS length_low
      FROM m GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbols <= symbols_high AND lines <= lines_high AND repeats <= repeats_high
    AND word_length BETWEEN length_low AND length_high AS kept, symbols, lines, repeats, word_length
FROM g LEFT JOIN lim ON g.lang IS NOT DISTINCT FROM lim.lang AND g.source IS NOT DISTINCT FROM lim.source
"""

ORACLE["op3_mix_sources"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len({_WORDS})::BIGINT AS size FROM documents),
k AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') || ':' || size AS id,
        (length(regexp_replace(t, '[#*$%&|<>!]', '', 'g')) + 1)::DOUBLE / (length(t) + 1)::DOUBLE AS c FROM d),
u AS (SELECT *, greatest(((c * c) * (c * c)) * ((c * c) * (c * c)), 1 / 256.0) AS weight,
        (('0x' || substr(md5('mix-1:' || id), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0 AS u FROM k),
keyed AS (SELECT doc_id, source, size, id || ':' || md5(t) AS id, -ln(u) / weight AS key FROM u),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM keyed GROUP BY source),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w,
        sum(source_size) OVER () * 150 / 100.0 AS budget FROM s
      WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * (budget - capped) >= 2.0 * source_size * open_w AS is_capped FROM o),
x AS (SELECT sum(source_size) * 150 / 100.0 - sum(CASE WHEN is_capped THEN 2 * source_size ELSE 0 END) AS share,
        sum(CASE WHEN is_capped THEN 0 ELSE w END) AS all_w FROM c),
t AS (SELECT source, source_size, CASE WHEN is_capped THEN 2.0 * source_size ELSE w * share::DOUBLE / all_w END::DOUBLE AS target
      FROM c, x),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (SELECT keyed.*, source_size, target, epochs, target - epochs * source_size AS rest,
        sum(size) OVER (PARTITION BY keyed.source ORDER BY key, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS mid
      FROM keyed JOIN e ON keyed.source IS NOT DISTINCT FROM e.source),
z AS (SELECT *, least(epochs + (mid <= rest)::BIGINT, 2)::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, source FROM z
"""

ORACLE["op10_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

ORACLE["op5_substring_dedup"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM rep, range(35) t(k)),
spans AS (SELECT r, count(*) AS n_removed, count(*) FILTER (WHERE first) AS n_spans
          FROM (SELECT r, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) <> i - 1, true) AS first FROM gone) GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text
         FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""
