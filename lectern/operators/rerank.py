"""Reranking: optional model scores, rules, and diversity.

All steps work on top-k lists, so a request has at most a few hundred rows here.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.functions import text as T
from lectern.operators.ranking import ranked
from lectern.operators.stage import written


def model_rerank(hits: DataFrame, score_fn: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Order by a model's relevance scores; without a model, or for one hit, nothing changes.

    Hits the model returns no score for follow in their old order with their old score.
    """
    if score_fn is None:
        return hits
    many = hits.join(hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")), "request_id")
    scored = many.withColumn(
        "_model", F.when(F.col("_n") > 1, score_fn(F.col("message"), F.left("text", F.lit(1500))))
    ).withColumnRenamed("rank", "_old")
    out = ranked(scored, ["request_id"], [F.col("_model").desc_nulls_last(), F.col("_old")])
    found = F.col("_model").isNotNull()
    return (
        out.withColumn("source", F.when(found, "model_reranked").otherwise(F.col("source")))
        .withColumn("score", F.when(found, F.col("_model")).otherwise(F.col("score")))
        .drop("_model", "_old", "_n")
    )


def rule_score(score: Column) -> Column:
    """Score after section, difficulty, reference and fact rules, in that order."""
    weighted = score * T.lookup(F.col("section_type"), X.SECTION_WEIGHTS, 1.0)
    target = T.lookup(F.col("student_level"), X.LEVEL_TARGETS, 0.5)
    weighted = weighted * (1.0 - F.abs(F.col("difficulty_score") - target) * 0.5)
    weighted = F.when(F.size("cross_refs") > 0, weighted * 1.05).otherwise(weighted)
    fact = T.is_fact_query(F.col("message"))
    weighted = F.when(fact & (T.number_count(F.col("text")) >= 2), weighted * 1.2 + 0.05).otherwise(weighted)
    return F.when(fact & (F.col("content_type") == "fact"), weighted * 1.3 + 0.1).otherwise(weighted)


def rule_rerank(hits: DataFrame) -> DataFrame:
    """Needs section_type, difficulty_score, cross_refs, content_type, text, message, student_level."""
    scored = hits.withColumn("score", rule_score(F.col("score"))).withColumnRenamed("rank", "_old")
    order = [T.settle(F.col("score"), 9).desc(), F.col("_old")]
    return ranked(scored, ["request_id"], order).drop("_old").withColumn("source", F.lit("rule_reranked"))


def diversity_cap(hits: DataFrame, most: int = X.MAX_PER_DOC) -> DataFrame:
    """At most ``most`` hits of a document per request, best ranks first."""
    doc = F.coalesce(T.blank_to_null(F.col("doc_id")), F.regexp_replace("chunk_id", "_[^_]*$", ""))
    keyed = hits.withColumn("_doc", doc)
    capped = ranked(keyed, ["request_id", "_doc"], [F.col("rank")], "_nth").where(F.col("_nth") <= most)
    return capped.drop("_doc", "_nth")


def _greedy_order(score: np.ndarray, docs: list, sections: list) -> np.ndarray:
    """New ranks of one list in its old order."""
    kinds = lambda names: np.array([seen.setdefault(n, len(seen)) for seen in ({},) for n in names])
    docs, sections = kinds(docs), kinds(sections)
    gain = X.MMR_LAMBDA * np.asarray(score, dtype=float)
    penalty = np.zeros(len(gain))
    left = np.ones(len(gain), dtype=bool)
    new_rank = np.zeros(len(gain), dtype="int32")
    for step in range(1, len(gain) + 1):
        value = gain - (1.0 - X.MMR_LAMBDA) * penalty
        # noise below 1e-9 must not decide between equal candidates
        pick = int(np.argmax(np.where(left, np.floor(value * 1e9 + 0.5), -np.inf)))
        new_rank[pick] = step
        left[pick] = False
        penalty += X.MMR_SAME_DOC * (docs == docs[pick]) + X.MMR_SAME_SECTION * (sections == sections[pick])
    return new_rank


def _greedy_orders(scores: pd.Series, docs: pd.Series, sections: pd.Series) -> pd.Series:
    """One list a row: lists are short and many, so a batch holds thousands of them."""
    return pd.Series([_greedy_order(*one) for one in zip(scores, docs, sections)], dtype=object)


def diversify(hits: DataFrame, most: int = X.MAX_PER_DOC) -> DataFrame:
    """Cap per document, then greedy maximal marginal relevance over the capped list."""
    capped = written(diversity_cap(hits, most), "capped")
    narrow = F.struct("rank", "chunk_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), "section_id", F.col("score").cast("double").alias("score"))
    lists = capped.groupBy("request_id").agg(F.sort_array(F.collect_list(narrow)).alias("l"))
    new_rank = F.pandas_udf(_greedy_orders, "array<int>")(F.col("l.score"), F.col("l.doc_id"), F.col("l.section_id"))
    order = lists.select("request_id", F.inline(F.arrays_zip(F.col("l.chunk_id").alias("chunk_id"), new_rank.alias("new_rank"))))
    return (
        capped.drop("rank")
        .join(order, ["request_id", "chunk_id"])
        .withColumnRenamed("new_rank", "rank")
        .withColumn("source", F.lit("diversity_reranked"))
    )


def cap_only(hits: DataFrame, k: int, most: int = X.MAX_PER_DOC) -> DataFrame:
    """The light variant: cap per document, order kept, first k."""
    capped = diversity_cap(hits, most).withColumnRenamed("rank", "_old")
    return ranked(capped, ["request_id"], [F.col("_old")]).where(F.col("rank") <= k).drop("_old")


def rerank(hits: DataFrame, score_fn=None, diversity: bool = True) -> DataFrame:
    """Model (if any), then rules, then diversity."""
    out = rule_rerank(model_rerank(hits, score_fn))
    return diversify(out) if diversity else out
