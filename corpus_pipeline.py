"""A corpus pipeline in five stages, each an operator of vellumgrid.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. run() applies them to the table documents, writing each stage's rows to the shared folder, so
that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumgrid.llm import line_dedup, packing, quality_classifier, simhash, substring_dedup
from vellumgrid.llm._shared import materialise, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores under its threshold go."""
    return quality_classifier.reject(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go from the texts."""
    return line_dedup.dedup(docs).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.dedup(docs).select(*docs.columns)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go from the texts."""
    return substring_dedup.remove(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are cut to pieces and packed into sequences: one row for each piece."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("substring dedup", dedup_substrings),
    ("best-fit packing", pack),
]
#: The classifier's fit, XXH64 fingerprints and packing are beyond SQL; tests/llm compares run()'s pieces with brute force on what the classifier keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
