"""Queries opN_<name> of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language, packing, placement, quality, shingle_join, substrings, token_store, tokens, warc
from .common import ship, table


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.op1(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.op2(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op3_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op3(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op5(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op6(table(spark, sf_dir, "pages"))


def op7_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.op7(table(spark, sf_dir, "documents"))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op9(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op10(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard_join, op2_token_store, op3_language_profiles, op4_benchmark_decontamination, op5_sequence_packing, op6_warc_archive, op7_shard_placement, op8_adaptive_quality, op9_repeated_substrings, op10_main_text]

    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": decontaminate.ORACLE, "op6_warc_archive": warc.ORACLE, "op7_shard_placement": placement.oracle(), "op8_adaptive_quality": quality.ORACLE}
