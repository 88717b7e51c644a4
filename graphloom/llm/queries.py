"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bigru, pieces_fst, quality, simhash, spans, suffixes, tiling, tokens, toxicity, warc
from graphloom.llm.common import cut, shared_dir, table


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.host_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id", "n_links")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    cut(warc.write(table(spark, sf_dir, "pages"), folder))
    return warc.read(spark, folder, keep_payload=False).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiling.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remaining(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = bigru.held_out(F.col("doc_id"), 3)
    out = bigru.predict(docs, bigru.train(docs.filter(fold != 1)))
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_fst.digests(table(spark, sf_dir, "documents"))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = bigru.held_out(F.col("doc_id"), 5)
    labels = table(spark, sf_dir, "labels").filter("toxic IS NOT NULL").select("doc_id", "toxic").filter(fold != 0)
    machine = toxicity.train(docs, labels)
    out = toxicity.score(docs, machine)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, row_number() OVER () AS rid,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n
  FROM (SELECT rid, i, list_slice(ws, i, i + 4) AS gram
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n_rep FROM g, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY rid
), m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(ls)::BIGINT AS n_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words
         OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed
  FROM m
), h AS (
  SELECT host, count(*) AS host_docs, sum(failed::INT)::BIGINT AS host_failed FROM f GROUP BY host
), p AS (
  SELECT avg(host_failed / host_docs) AS mean, var_pop(host_failed / host_docs) AS var FROM h
), q AS (
  SELECT mean, CASE WHEN var = 0 THEN 1e4 ELSE least(1e4, greatest(1, mean * (1 - mean) / var - 1)) END AS n FROM p
), v AS (
  SELECT host, host_docs, host_failed, (host_failed + mean * n) / (host_docs + n) > 0.5 AS host_bad FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (CASE WHEN host_bad THEN failed ELSE base_failed END) AS kept, host_docs, host_failed
FROM f JOIN v USING (host)
"""


#: Every query of this package, by name.
QUERIES = {f.__name__: f for f in (op1_token_counts, op2_greedy_tiling, op3_suffix_array, op4_sentence_spans, op5_byte_bigru, op6_simhash, op7_host_quality, op8_sentencepiece, op9_string_kernel, op10_warc)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op7_host_quality": OP7_SQL}
