"""Rank fusion, the hybrid rule and the memory boost.

Hits: request_id, doc_id, pos, score, rank, source (+ metadata columns where needed).
A request searches one document, so (request_id, pos) names a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.functions import text as T
from lectern.operators.ranking import ranked, top_k

KEYS = ["request_id", "pos"]


def fuse(lists: DataFrame, k_col: str | None = None, most: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of weighted lists (list_no, weight, rank per row).

    Lists weighing no more than 0.001 are skipped. Equal scores keep the order in which
    the chunks first appear, list by list.
    """
    kept = lists.where(F.col("weight") > X.RRF_MIN_WEIGHT)
    fused = kept.groupBy(*KEYS).agg(
        F.sum(F.col("weight") / (X.RRF_K + F.col("rank"))).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("_seen"),
        *([F.max(k_col).alias(k_col)] if k_col else []),
    )
    order = [T.settle(F.col("score"), 12).desc(), F.col("_seen")]
    out = top_k(fused, ["request_id"], order, k_col, most=most) if k_col else ranked(fused, ["request_id"], order)
    return out.drop("_seen", *([k_col] if k_col else [])).withColumn("source", F.lit("rrf_fused"))


def boost_facts(vector_hits: DataFrame) -> DataFrame:
    """Number-dense chunks gain 30 % and the list is ranked again."""
    boosted = vector_hits.withColumn(
        "score",
        F.when(F.col("content_type") == "fact", F.col("score") * X.FACT_BOOST).otherwise(F.col("score")),
    ).withColumnRenamed("rank", "_old")
    return ranked(boosted, ["request_id"], [F.col("score").desc(), F.col("_old")]).drop("_old")


def lexical_signal(lexical_hits: DataFrame) -> DataFrame:
    """How much a request's best lexical score says, 0..1."""
    return lexical_hits.groupBy("request_id").agg(
        F.least(F.max("score") / X.SIGNAL_SCALE, F.lit(1.0)).alias("signal")
    )


def hybrid(lexical_hits: DataFrame, vector_hits: DataFrame, requests: DataFrame, most: int = 400) -> DataFrame:
    """Lexical and vector lists in one, per request:

    no vector hits -> the lexical list as it is; signal below 0.05 -> the vector list
    alone; otherwise fusion weighted (signal, 1).
    """
    cols = [*KEYS, "score", "rank", "source"]
    vec = boost_facts(vector_hits)
    has_vec = vec.select("request_id").distinct().withColumn("has_vec", F.lit(True))
    state = (
        requests.select("request_id", "k")
        .join(has_vec, "request_id", "left")
        .join(lexical_signal(lexical_hits), "request_id", "left")
        .select(
            "request_id",
            "k",
            F.coalesce("has_vec", F.lit(False)).alias("has_vec"),
            F.coalesce("signal", F.lit(0.0)).alias("signal"),
        )
    )
    lex = lexical_hits.select(*cols).join(state, "request_id")
    vec = vec.select(*cols).join(state, "request_id")
    mixed = F.col("has_vec") & (F.col("signal") >= X.SIGNAL_MIN)
    lists = (
        lex.where(mixed).select(*KEYS, "rank", "k", F.lit(0).alias("list_no"), F.col("signal").alias("weight"))
        .unionByName(vec.where(mixed).select(*KEYS, "rank", "k", F.lit(1).alias("list_no"), F.lit(1.0).alias("weight")))
    )
    return (
        fuse(lists, "k", most).select(*cols)
        .unionByName(lex.where(~F.col("has_vec")).select(*cols))
        .unionByName(
            vec.where((F.col("signal") < X.SIGNAL_MIN) & (F.col("rank") <= F.col("k"))).select(*cols)
        )
    )


def concept_match(text: Column, text_tokens: Column, concepts: Column) -> Column:
    """Whether any of the first eight concepts is contained in the text, by tokens or literally."""

    def one(concept: Column) -> Column:
        wanted = T.tokens(concept)
        by_tokens = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, text_tokens)) == 0)
        return by_tokens | F.contains(F.lower(text), concept)

    cleaned = F.filter(F.transform(concepts, lambda c: T.strip(F.lower(c))), lambda c: c != "")
    return F.exists(F.slice(cleaned, 1, 8), one)


def memory_boost(hits: DataFrame, hints: DataFrame) -> DataFrame:
    """Raise hits in the section being read and hits on concepts under review.

    ``hints``: request_id, current_section_id, concepts. Hits need section_id and text.
    """
    joined = hits.join(
        hints.select("request_id", "current_section_id", "concepts"), "request_id", "left"
    ).withColumn("_tokens", F.array_distinct(T.tokens(F.col("text"))))
    here = F.coalesce(
        (F.col("current_section_id") != "") & (F.col("current_section_id") == F.col("section_id")), F.lit(False)
    )
    score = F.when(here, F.col("score") * 1.25 + 2.0).otherwise(F.col("score"))
    known = F.coalesce(concept_match(F.col("text"), F.col("_tokens"), F.col("concepts")), F.lit(False))
    boosted = joined.withColumn("score", score).withColumn(
        "score", F.when(known, F.col("score") * 1.2 + 2.0).otherwise(F.col("score"))
    )
    boosted = boosted.withColumnRenamed("rank", "_old").drop("_tokens", "current_section_id", "concepts")
    return ranked(boosted, ["request_id"], [F.col("score").desc(), F.col("_old")]).drop("_old")
