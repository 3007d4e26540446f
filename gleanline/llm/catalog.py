"""Queries over the whole test tables, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, fingerprints, hybrid_rank, language_id, line_dedup, near_dedup, packing, periodic_runs, piece_codec
from . import quality_classifier, quality_rules, secret_scan, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under `name`."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"), width=3, percent=85)


@query("op2_secret_scan", secret_scan.oracle())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(table(spark, folder, "documents")))


@query("op5_line_dedup", line_dedup.oracle())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, folder, "documents")))


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op3_quality_rules", quality_rules.oracle())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judge(table(spark, folder, "documents")))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_query(table(spark, folder, "documents"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.quality_query(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_class_lm")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.lm_query(table(spark, folder, "documents"))


@query("op6_fingerprints")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query("op4_piece_codec")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.codec_query(table(spark, folder, "documents"))


@query("op11_hybrid_rank", hybrid_rank.oracle())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid_rank.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_token_counts")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.runs_query(table(spark, folder, "documents"))
