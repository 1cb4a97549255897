"""Scores of pages: computed once a row whatever is filtered, in linear time, with the values they had."""

import time

from pyspark.sql import functions as F

from lectern.catalog import documents
from lectern.functions import text as T
from lectern.operators import analysis, chunking, quality


def pages(spark):
    return spark.createDataFrame([(1, 0, "a b", "slides_pdf")], "doc_id long, page_num int, text string, doc_subtype string").select(
        "*", F.length("text").alias("char_count"), *[F.lit(False).alias(f"on_{k}") for k in ("image", "table", "formula")]
    )


def test_filters_on_scores_do_not_repeat_them(spark):
    weak = quality.weak_pages(quality.page_quality(quality.measured(pages(spark))))
    plan = weak.drop("text_preview")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("array_distinct") == 1


def test_statistics_of_odd_texts(spark):
    texts = ["", " ", "a", " a  b \n\x0b c ", "\n", "x" * 5, "A b " * 7, "ä! 1 \U0001d6fc ?", "...a...", "..ab", "(.) ,x? �", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    t = F.col("t")
    got = rows.select("n", T.word_count(t), T.line_count(t), T._symbols(t), T.repetition_ratio(t), T.fragmentation(t)).orderBy("n").collect()
    assert [r[1] for r in got] == [None if s is None else len(s.split()) for s in texts]
    assert [r[2] for r in got] == [None if s is None else sum(bool(x.strip()) for x in s.splitlines()) for s in texts]
    assert [r[3] for r in got] == [None if s is None else sum(not (c.isalnum() or c.isspace()) for c in s) for s in texts]
    assert [r[4] for r in got] == [0.5 - 2 / 14 if s == "A b " * 7 else 0.0 for s in texts]

    def share(s):
        words = (s or "").split()
        odd = sum(len(w.strip(".,;:()[]{}")) <= 1 for w in words) + sum("?" in w or "�" in w for w in words)
        return min(1.0, odd / len(words)) if words else 1.0

    assert [r[5] for r in got] == [share(s) for s in texts]


def test_a_word_of_any_length_is_read_once(spark):
    long = spark.createDataFrame([("x" * 400_000 + " " + "." * 20_000 + "ab",)], "t string")
    started = time.time()
    assert long.select(T.fragmentation(F.col("t"))).first()[0] == 0.0
    assert time.time() - started < 20


def test_a_chunk_right_behind_the_head_gives_its_blank(spark):
    chunks = spark.createDataFrame([("d", "s", 0, "x" * 899), ("d", "s", 1, "next")], "doc_id string, section_id string, pos int, text string")
    assert analysis.section_heads(chunks, 900).first()["head"] == "x" * 899 + " "


def test_dollars_behind_a_word(spark, tmp_path):
    """The query's SQL knows no display math; chunking does."""
    spark.createDataFrame([(5, "one word$$$")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.kind for r in documents.semantic_blocks(spark, str(tmp_path)).collect()] == ["prose"]
    unit = spark.createDataFrame([("x $$", False)], "text string, courseware boolean")
    assert chunking.with_blocks(unit).select("blocks.kind").first()[0] == ["formula"]
