"""The registered queries of this subpackage and, where SQL states their result, that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, html_text, line_dedup, lm, mixing, near_dedup, pii, token_counts, topk, toxicity
from tessera.llm.common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(read(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(read(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(read(spark, sf_dir, "embeddings"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_token_counts, op3_decontamination, op4_html_text, op5_mixing, op6_line_dedup, op7_toxicity, op8_near_dedup, op9_topk, op10_lm)
}

ORACLE = {
    "op5_mixing": mixing.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op9_topk": topk.SQL,
}
