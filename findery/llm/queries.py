"""The queries opN_* over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, lines, maxent, neardup, pages, quality, repeats, ring, rules
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.op1(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op2(read_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.op4(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.op5(read_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op6(read_table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op7(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op8(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op9(read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op10(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_line_dedup,
        op3_quality_classifier,
        op4_sharding,
        op5_html_extraction,
        op6_suffix_dedup,
        op7_minhash_dedup,
        op8_decontamination,
        op9_quality_rules,
        op10_byte_bpe,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.OP2_SQL,
    "op6_suffix_dedup": repeats.OP6_SQL,
    "op7_minhash_dedup": neardup.OP7_SQL,
    "op9_quality_rules": rules.OP9_SQL,
}
