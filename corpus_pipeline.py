"""A training corpus out of raw documents: the stages of ``STAGES``, each written and read again.

Good texts, without toxic ones, one of each group of near copies, without benchmark passages,
mixed to the source weights. Every stage judges all that its predecessor kept and learns from
the labels of those documents; all but the last return the columns of ``documents``.
Null doc_ids, null texts and repeated rows pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, mixing, neardup, quality, toxicity
from lectern.llm.columns import table
from lectern.operators.stage import written
from lectern.session import ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neardup.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
]
#: Learnt models and random rounding are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
