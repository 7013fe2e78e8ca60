"""Registered queries of the training-data operators: each reads its whole tables and applies its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lm_score, oracles, pii, quality, sentencepiece_fst, simhash, suffix_dedup, token_counts, tool_chat, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts.report(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op3_lm_score(spark, sf_dir):
    return lm_score.report(_table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.report(_table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.report(_table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_tool_chat(spark, sf_dir):
    return tool_chat.report(_table(spark, sf_dir, "conversations"))


def op8_topk(spark, sf_dir):
    return topk.report(_table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark, sf_dir):
    return sentencepiece_fst.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
