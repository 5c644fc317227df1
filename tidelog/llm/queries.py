"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, language, licences, media, mixing, neardup, quality, repetition, tokencount, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_media(spark, _table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(_table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_responses(spark, _table(spark, sf_dir, "pages"))


def op9_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_media_columns": op2_media_columns,
        "op3_bpe": op3_bpe,
        "op4_quality_rules": op4_quality_rules,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_token_counts": op7_token_counts,
        "op8_warc": op8_warc,
        "op9_licence_scans": op9_licence_scans,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_media_columns": """
SELECT page_id, 'pages/' || page_id || '.html' AS member, CAST(strlen(html) AS BIGINT) AS size, CASE WHEN regexp_matches(html, '(?i)^\\s*(<!doctype html|<html)') THEN 'text/html' ELSE 'application/octet-stream' END AS media_type, md5(html) AS md5, html AS body, CAST(NULL AS VARCHAR) AS error
FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL""",
        "op4_quality_rules": repetition.rules_sql(),
        "op8_warc": """
SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, 200 AS status, 'text/html' AS content_type, CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS md5, html
FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL""",
    }
