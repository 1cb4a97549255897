"""How the driver's tables stand for documents, chunks, requests, vectors and events.

Flat mapping: a document is a ``documents.source``, a chunk is one ``documents`` row
(pos = doc_id, section = lang). A request is a ``benchmark`` row; it asks one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions import notation, text as T

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_section_type(doc_id: Column) -> Column:
    return (
        F.when(doc_id % 5 == 0, "method")
        .when(doc_id % 5 == 1, "results")
        .when(doc_id % 5 == 2, "prose")
        .when(doc_id % 5 == 3, "citation_context")
        .otherwise("references")
    )


def derived_difficulty(n_chars: Column) -> Column:
    return F.when(n_chars < 1000, 0.3).when(n_chars < 3000, 0.5).otherwise(0.8)


def flat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per documents row; the row's source is its document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("doc_id"),
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("lang").alias("section_id"),
        "text",
        F.col("text").alias("search_text"),
        derived_section_type(F.col("doc_id")).alias("section_type"),
        derived_difficulty(F.col("n_chars")).alias("difficulty_score"),
        F.when(T.number_count(F.col("text")) >= 2, "fact").otherwise("text").alias("content_type"),
        (F.col("doc_id") % 4 == 0).alias("is_slide"),
        (F.col("doc_id") % 3 == 0).alias("has_formula"),
        (F.col("doc_id") % 97).cast("int").alias("page_start"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("message"))
    return b.withColumn("query", T.expanded_query(F.col("message"), notation.normalize(F.col("message"))))


def addressed(queries: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query asks one document: the source of the row that has the query's number."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("doc_id"))
    return queries.join(asked, "query_id").withColumn(
        "request_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("doc_id"))
    )


def benchmark_requests(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return addressed(benchmark_queries(spark, sf_dir), spark, sf_dir).withColumn("k", F.lit(k))
