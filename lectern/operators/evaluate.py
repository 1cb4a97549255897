"""Retrieval traces and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T


def projected(hits: DataFrame, include_text: bool = False) -> DataFrame:
    """Hits as shown in a trace: score to six digits, preview of 240 characters."""
    cols = [
        "request_id", "chunk_id", "rank", T.round_exact(F.col("score"), 6).alias("score"), "source",
        F.coalesce("section_id", F.lit("")).alias("section_id"), "page_start", F.left("text", F.lit(240)).alias("text_preview"),
    ]
    return hits.select(*cols, *(["text"] if include_text else []))


def trace(stages: dict[str, DataFrame]) -> DataFrame:
    """All stages of a retrieval in one table, told apart by ``stage``."""
    parts = [projected(df).withColumn("stage", F.lit(name)) for name, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def _matches(item_text: Column) -> Column:
    any_in = lambda values, c: F.coalesce(F.array_contains(values, c), F.lit(False))
    return (
        any_in(F.col("chunk_ids"), F.col("chunk_id"))
        | any_in(F.col("section_ids"), F.col("section_id"))
        | any_in(F.col("pages"), F.col("page_start"))
        | F.coalesce(
            F.exists(F.filter("terms", lambda t: t != ""), lambda t: T.contains_squeezed(item_text, t)), F.lit(False)
        )
    )


def case_metrics(cases: DataFrame, targets: DataFrame, evidence: DataFrame, context: DataFrame) -> DataFrame:
    """Metrics per case; a case without targets only says whether retrieval was empty.

    ``cases``: case_id. ``targets``: case_id, target_no, chunk_ids, section_ids, pages, terms.
    ``evidence`` / ``context``: case_id, rank, chunk_id, section_id, page_start, text.
    """
    wanted = targets.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_targets"))
    shown = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_evidence"))

    def found(items: DataFrame, prefix: str) -> DataFrame:
        hit = items.join(targets, "case_id").where(_matches(F.col("text")))
        return hit.groupBy("case_id").agg(
            F.min("rank").alias(f"{prefix}_rank"), F.count_distinct("target_no").alias(f"{prefix}_matched")
        )

    j = (
        cases.select("case_id")
        .join(wanted, "case_id", "left")
        .join(shown, "case_id", "left")
        .join(found(evidence, "evidence"), "case_id", "left")
        .join(found(context, "context"), "case_id", "left")
    )
    has = F.col("n_targets").isNotNull()
    matched = lambda p: F.coalesce(F.col(f"{p}_matched"), F.lit(0))
    return j.select(
        "case_id",
        F.when(has, F.when(F.col("evidence_rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit_at_k"),
        F.when(has, F.when(matched("context") > 0, 1.0).otherwise(0.0)).alias("context_hit_at_k"),
        F.when(has, F.coalesce(T.round_exact(1.0 / F.col("evidence_rank"), 3), F.lit(0.0))).alias("mrr_at_k"),
        F.when(has, T.round_exact(matched("evidence") / F.col("n_targets"), 3)).alias("recall_at_k"),
        F.when(has, T.round_exact(matched("context") / F.col("n_targets"), 3)).alias("context_recall_at_k"),
        F.col("evidence_rank"),
        F.when(F.col("n_evidence").isNull(), 1.0).otherwise(0.0).alias("empty_retrieval"),
    )


METRICS = "hit_at_k context_hit_at_k mrr_at_k recall_at_k context_recall_at_k".split()


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the cases that have the metric."""
    mean = lambda c: T.round_exact(T.settle(F.avg(c), 9), 3)
    return metrics.agg(
        F.count(F.lit(1)).alias("num_cases"),
        *[mean(m).alias(m) for m in METRICS],
        mean("empty_retrieval").alias("empty_retrieval_rate"),
    )
