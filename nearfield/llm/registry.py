"""Queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, languages, lines, ngrams, packing, quality, rendering, secrets, simhash, tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_shards(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identified(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cleaned(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.extracted(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_simhash_dedup,
        op3_token_shards,
        op4_language_id,
        op5_lm_scores,
        op6_line_frequency,
        op7_quality_classifier,
        op8_html_text,
        op9_secret_scan,
        op10_hilbert_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": """
WITH item AS (
  SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM benchmark
), split AS (
  SELECT item_id, string_split(t, ' ') AS w FROM item WHERE t <> ''
), gram AS (
  SELECT DISTINCT item_id, ' ' || array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') || ' ' AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM split)
), doc AS (
  SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents
)
SELECT doc_id, item_id, count(*) AS n_windows FROM doc JOIN gram ON contains(t, g) GROUP BY doc_id, item_id
""",
    "op6_line_frequency": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text FROM documents
), line AS (
  SELECT r, doc_id, host, i, raw, trim(regexp_replace(lower(raw), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm
  FROM (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text <> '')
), often AS (
  SELECT host, norm FROM line WHERE norm <> '' GROUP BY host, norm HAVING count(DISTINCT doc_id) > 10
), judged AS (
  SELECT r, i, raw, often.norm IS NOT NULL AS gone, CASE WHEN line.norm = '' THEN 0 ELSE len(string_split(line.norm, ' ')) END AS words
  FROM line LEFT JOIN often ON line.host = often.host AND line.norm = often.norm
), made AS (
  SELECT r, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sum(words) AS words, coalesce(sum(words) FILTER (NOT gone), 0) AS kept
  FROM judged GROUP BY r
)
SELECT doc_id, CASE WHEN made.r IS NULL THEN d.text ELSE coalesce(made.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_removed = 0 OR (kept > 0 AND kept >= 0.5 * words), true) AS keep
FROM d LEFT JOIN made ON d.r = made.r
""",
}
