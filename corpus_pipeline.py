"""The corpus pipeline: five operators in a row, each over all that its predecessor kept.

1. quality classifier: documents that it rejects go.
2. SimHash near-dedup: of each group of near copies, the document with the least id stays. Near copies share 0.8 or more of their shingles of
   five words: candidates come from the ring of the fingerprints and, beyond its radius, from rare shingles; each is verified exactly.
3. benchmark decontamination: contaminated documents go.
4. secret scans: every secret found in a text is masked; all documents stay.
5. mixing sources to target weights: words taken from each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import decontamination, mixing, quality_classifier, secret_scan, simhash
from gaugeworks.llm.common import Written, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
]

#: The classifier is learned, so SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        now = Written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if before:  # its successor is written; the last one is read by the result
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
