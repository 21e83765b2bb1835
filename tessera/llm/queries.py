"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (exact_dedup, language_id, license_scan, line_dedup, merkle_manifest, mixing, ngram_join, quality_rules, ranked_search,
               sentencepiece_bpe, substring_dedup, suffix_dedup, token_output)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_digest(documents(spark, sf_dir))


@register("op2_token_output")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.training_shards(documents(spark, sf_dir))


@register("op3_substring_dedup", substring_dedup.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(documents(spark, sf_dir))


@register("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.roundtrip_digest(documents(spark, sf_dir))


@register("op5_line_dedup", line_dedup.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(documents(spark, sf_dir))


@register("op6_quality_rules", quality_rules.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(documents(spark, sf_dir))


@register("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digest(documents(spark, sf_dir))


@register("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(documents(spark, sf_dir))


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


OP10_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""


@register("op10_exact_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    rows = exact_dedup.exact_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op11_ranked_search", ranked_search.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return ranked_search.ranked_search(documents(spark, sf_dir), items)


@register("op12_merkle_manifest", merkle_manifest.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_digest(documents(spark, sf_dir))


@register("op13_license_scan", license_scan.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_scan(documents(spark, sf_dir))
