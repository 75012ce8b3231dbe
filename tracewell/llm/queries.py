"""Queries of this package: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tracewell.llm import decontamination, licenses, merkle, near_duplicates, oracle, packing, pii, quality, resampling, sharding, suffixes, topk, toxicity, urls
from tracewell.llm.common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("detections")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(read(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_topk_search": op11_topk_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": pipeline,
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
_LEADS = [f"lead(word, {k}) OVER o" for k in range(1, 10)]

#: The same results in SQL, where it can say them and is fast enough on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
 v AS (SELECT item_id, least(10, len(ws)) AS size, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
 wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM v),
 dw AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
 gs AS (SELECT doc_id, i, ["""
    + ", ".join("word" + "".join(f" || ' ' || {x}" for x in _LEADS[:k]) for k in range(10))
    + r"""] AS g FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 sizes AS (SELECT DISTINCT size FROM wins),
 hits AS (SELECT doc_id, i, sizes.size AS size, item FROM gs, sizes JOIN wins ON wins.size = sizes.size AND wins.g = gs.g[sizes.size]),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
 its AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
 g AS (SELECT doc_id, i, word"""
    + "".join(f" || ' ' || {x}" for x in _LEADS[:7])
    + r""" AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM r) GROUP BY doc_id),
 s AS (SELECT doc_id, CAST(sum(length(word)) AS BIGINT) AS chars, count(*) FILTER (lower(word) IN ("""
    + _STOP
    + r""")) AS stop FROM u GROUP BY doc_id),
 m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(s.chars, 0) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(s.stop, 0) AS stop, len(ls) AS n_lines FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)),
 q AS (SELECT *, n_symbols / nullif(n_words, 0) AS symbol_ratio, stop / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
 f AS (SELECT *, concat_ws(',', CASE WHEN word_chars / nullif(n_words, 0) < 1.5 OR word_chars / nullif(n_words, 0) > 25 THEN 'mean_word_chars' END, CASE WHEN symbol_ratio > 0.3 THEN 'symbols' END, CASE WHEN stop_word_ratio < 0.005 THEN 'stop_words' END, CASE WHEN dup_line_ratio > 0.5 THEN 'duplicate_lines' END) AS failed_rules FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules, symbol_ratio, stop_word_ratio, dup_line_ratio FROM f""",
    "op11_topk_search": oracle.TOPK,
    "op12_merkle_manifest": oracle.MERKLE,
    "op13_importance_resampling": oracle.RESAMPLING,
}
