"""The registered queries of the training-data operators: each applies its operator with
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearth.llm import (decontaminate, filter_audit, licenses, line_dedup, mixing, quality, secret_scan, simhash, spelling, token_counts,
                        token_files, toxicity, url_filter)
from hearth.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op2(spark, table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op3(spark, table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op5(spark, table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op6(spark, table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op7(spark, table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8_near(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(spark, table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(spark, table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op11(spark, table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op12(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op13(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_secret_scan, op3_simhash_near_dedup, op4_toxicity, op5_token_files, op6_url_filter,
                            op7_line_dedup, op8_decontamination, op8_proximity, op9_source_mix, op10_license_scan,
                            op11_token_counts, op12_filter_audit, op13_spelling_variants)}

#: DuckDB SQL where SQL can express the whole result.
ORACLES: dict[str, str] = {"op7_line_dedup": line_dedup.ORACLE, "op8_decontamination": decontaminate.ORACLE,
                           "op12_filter_audit": filter_audit.ORACLE}
