"""Rows that are dear to compute are computed once before they are laid by ranges."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.catalog import study
from lectern.sources.store import Store


def test_page_scores_are_written_before_they_are_laid(spark, monkeypatch):
    laid, replace = {}, Store.replace

    def watched(self, artifact, rows):
        laid[artifact] = rows._jdf.queryExecution().optimizedPlan().toString()
        return replace(self, artifact, rows)

    monkeypatch.setattr(Store, "replace", watched)
    assert entry.queries()["analysis_responses"](spark, "/root/testdata/sf0.001").count() > 0
    assert "Relation" in laid["page_quality"] and "Generate" not in laid["page_quality"]


def test_vectors_are_embedded_once_a_chunk(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    asked = spark.sparkContext.accumulator(0)

    def embed(text):
        return F.udf(lambda t: (asked.add(1), [1.0])[1], "array<double>")(text)

    from lectern.operators import chunking

    docs = spark.createDataFrame([(i, "research_paper", "one two three") for i in range(50)], "doc_id bigint, doc_subtype string, raw_text string")
    from lectern.catalog.documents import no_sections

    store.index_vectors(chunking.chunk(chunking.paper_units(docs, no_sections(spark))), embed)
    assert store.read("vectors").count() == 50 and asked.value == 50
