"""A corpus pipeline: good documents, one of each group, no benchmark leaks, no secrets, mixed sources.

Each stage takes what the one before kept.  ``run`` writes every stage to the
shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import decontaminate, jaccard, mixture, quality, secrets
from logweir.llm.common import read
from logweir.session import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained quality scorer accepts."""
    return quality.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, the one with the smallest id."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of benchmark text, whatever its numbers and names."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redact(docs, secrets.ledger_at(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document so that sources meet their targets."""
    return mixture.taken(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("source mixture", mix_sources),
]

#: Trained scores, hashed signatures and drawn blocks have no SQL twin; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
