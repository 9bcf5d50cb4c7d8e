"""Queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import audio, chat, decontam, htmltext, langid, merkle, mixing, neardup, quality, secrets, sharding, substrings, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op1_chat(_table(spark, sf_dir, "conversations"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op2_near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op3_secrets(_table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4_mix(_table(spark, sf_dir, "documents"))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.op5_audio(_table(spark, sf_dir, "documents"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6_shards(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op7_language(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op8_main_text(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op10_decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op11_trie(_table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12_merkle(_table(spark, sf_dir, "documents"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op13_substrings(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sized UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT CAST(s.doc_id AS BIGINT) AS doc_id, s.n AS n_shingles, CAST(min(r.r) AS BIGINT) AS component_id, s.doc_id = min(r.r) AS kept
FROM sized s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n
"""

OP10_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win))
), hit AS (SELECT spot.doc_id, spot.i, spot.k, win.item_id FROM spot JOIN win ON spot.g = win.g AND spot.k = win.k),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT CAST(doc.doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n_hit ON doc.doc_id = n_hit.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for operators that SQL can express; the others are held against brute force in tests/llm."""
    return {"op1_chat": chat.OP1_SQL, "op2_near_duplicates": OP2_SQL, "op10_decontaminate": OP10_SQL, "op11_trie": trie.OP11_SQL, "op12_merkle": merkle.OP12_SQL, "op13_substrings": substrings.OP13_SQL}
