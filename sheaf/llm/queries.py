"""Queries over the operators: ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, hard_negatives, kneser_ney, licences, packing, pii, quality, secret_scan, simhash, spelling, tokens
from .common import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op1(table(spark, sf_dir, "documents"))


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op3(table(spark, sf_dir, "documents"))


def op4_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op4(table(spark, sf_dir, "embeddings"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op5(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.op6(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op8(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op10(spark, table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op11(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op12(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_bpe_encode_decode, op2_pii_weak_supervision, op3_simhash_near_dedup, op4_approximate_neighbours, op5_licence_scan, op6_lm_scoring, op7_quality_rules, op8_token_counts,
        op9_best_fit_packing, op10_chat_formatting, op11_spelling_variants, op12_hard_negatives, op13_secret_scan)}


def oracles() -> dict[str, str]:
    return {"op7_quality_rules": quality.oracle_sql(), "op10_chat_formatting": chat.ORACLE,
            "op12_hard_negatives": hard_negatives.ORACLE}
