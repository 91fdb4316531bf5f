"""Registered queries: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import (
    alignment, decontaminate, filter_audit, fingerprints, html_extract, jaccard, mixture, packing, quality, repeats,
    secrets, toxicity, warc,
)
from logweir.llm.checks import CHECKS as CHECKS
from logweir.llm.common import read


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(read(spark, folder, "documents"))


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(read(spark, folder, "pages"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(read(spark, folder, "documents"))


def op6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.taken(read(spark, folder, "documents"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(read(spark, folder, "documents"), secrets.ledger_at(spark))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read(spark, folder, "pages"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove(read(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(read(spark, folder, "documents"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.report(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard": op3_jaccard,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_mixture": op6_mixture,
    "op7_secrets": op7_secrets,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_repeats": op10_repeats,
    "op11_filter_audit": op11_filter_audit,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}


