"""What a job writes on its way goes when it is no longer read, and so do its shuffle files."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from lectern.functions import text as T
from lectern.operators import stage
from lectern.plans import enhancement
from lectern.session import shared_dir
from lectern.sources.store import Store


def tables(spark) -> set[str]:
    folder = f"{shared_dir(spark).removeprefix('file://').rstrip('/')}/lectern-{spark.sparkContext.applicationId}"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def shuffles(spark) -> set[int]:
    """The shuffles of which the executors hold files."""
    ids = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {int(name.split("_")[1]) for name in (line.rsplit("/", 1)[-1] for line in ids.split("\n")) if name.startswith("shuffle_")}


def test_tables_go_with_the_block_they_were_written_in(spark):
    before = tables(spark)
    rows = spark.range(5)
    with stage.passing(spark):
        stage.written(rows, "inner-a")
        with stage.passing(spark):
            stage.written(rows, "inner-b")
            out = stage.written(rows, "outer", lasting=True)
        assert {t.rsplit("-", 1)[0] for t in tables(spark) - before} == {"inner-a", "outer"}
        assert out.count() == 5
    assert tables(spark) == before
    kept = stage.alone(spark, lambda: stage.written(rows, "on-the-way").where("id > 1"), "kept")
    assert kept.count() == 3 and {t.rsplit("-", 1)[0] for t in tables(spark) - before} == {"kept"}


def test_tables_go_when_a_job_fails(spark):
    before = tables(spark)
    with pytest.raises(ValueError), stage.passing(spark):
        stage.written(spark.range(2), "failing")
        raise ValueError
    assert tables(spark) == before


def test_shuffle_files_go_with_the_write(spark):
    try:
        setting = spark.conf.get(stage._FILES_GO)
    except Exception:  # noqa: BLE001
        pytest.skip("this version of Spark keeps them")
    before = shuffles(spark)
    stage.written(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count(), "grouped")
    assert spark.conf.get(stage._FILES_GO) == setting
    for _ in range(50):  # they go behind the write
        if not shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - before


def test_an_enhancement_leaves_one_copy(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    text = "A slide about rivers, and how they find their way to the sea."
    store.replace("documents", spark.createDataFrame([("a", "slides_pdf"), ("b", "research_paper")], "doc_id string, doc_subtype string"))
    pages = spark.createDataFrame([(d, p, text * (p + 1)) for d in "ab" for p in range(3)], "doc_id string, page_num int, text string")
    flags = [F.lit(False).alias(c) for c in enhancement.FLAGS]
    store.replace("doc_pages", pages.select("*", F.length("text").alias("char_count"), F.lit("parser").alias("content_source"), F.lit(False).alias("enhanced"), *flags))
    none = F.array().cast("array<string>")
    found = pages.where("page_num = 1").select(
        "doc_id", F.col("page_num").alias("page"), F.lit(0).alias("fragment_no"), F.lit("ocr").alias("source"), F.lit("Read again: " + text * 4).alias("text"),
        F.lit("good").alias("quality"), F.lit("").alias("visual_type"), none.alias("key_observations"),
        *[F.lit("").alias(c) for c in ("table_summary", "formula_summary", "chart_summary", "qa_hint")],
    )
    store.replace("ocr_pages", found)
    before = tables(spark)
    got = enhancement.apply(store)
    assert {t.rsplit("-", 1)[0] for t in tables(spark) - before} == {"enhancement-standing", "enhancement-counts"}
    assert {(r["doc_id"], r["status"]) for r in got.collect()} == {("a", "applied"), ("b", "applied")}
    assert store.read("enhanced_pages").count() == 6 and store.read("page_quality").count() > 0 and store.read("chunks").count() > 0
    assert store.read("doc_sections").where(T.strip(F.col("gist")) == "").count() == 0


@pytest.mark.parametrize("name, more", [("chat_answers", {"user-turns"}), ("retrieve_context", set())])
def test_answers_keep_texts_once(spark, tmp_path, name, more):
    docs = [(d, f"Alpha beta document {d}. It tells of gamma rays and of rivers. " * 40) for d in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    said = [(0, t, "user", f"What of river {t}?") for t in range(2)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    before = tables(spark)
    assert entry.queries()[name](spark, str(tmp_path)).count() >= 3
    left = {t.rsplit("-", 1)[0]: t for t in tables(spark) - before}
    assert set(left) == {"chunks", "requests", "lexical", "candidates", "hits", "context"} | more
    stored = spark.read.parquet(f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}/{left['chunks']}")
    assert "text" in stored.columns and "search_text" not in stored.columns
