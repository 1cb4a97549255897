"""Counts of texts: taken once, before texts are grouped or joined, with the scores the patterns give."""

import re

from pyspark.sql import functions as F

from lectern.functions import fixed as X
from lectern.functions import measures
from lectern.functions import text as T
from lectern.operators import enhance

TEXTS = ["", " ", "a", " a  b \n\x0b c ", "\n", "x" * 50, "A b " * 7, "ä! 1 \U0001d6fc ?", "...a...", "..ab", "(.) ,x? � |", "\x1c  word　", "é́ ½ _x_ 中文 [OCR]", "ab " * 400 + "." * 300]


def test_counts_give_the_scores_of_the_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, t string")
    m, t = F.col("m"), F.col("t")
    s = T.squeeze(t)
    got = measures.with_counts(rows, "t", "m").select(
        measures.readability(m), T.readability(t), measures.fragmentation(m), T.fragmentation(t),
        measures.symbol_ratio(m), T.symbol_ratio(s), measures.length(m), F.length(s),
    )
    for r in got.collect():
        assert r[0] == r[1] and r[2] == r[3] and r[4] == r[5] and r[6] == r[7]


def test_strip_and_quote_as_by_patterns(spark):
    texts = [*TEXTS, " " * 5000 + "x" + " " * 900 + "y " * 300, "x" + " " * 5000 + "y", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", T.strip(F.col("t")).alias("s"), T.quote(F.col("t"), 180).alias("q"), F.left(T.squeeze(F.col("t")), F.lit(180)).alias("plain")).collect():
        assert r.s == (None if r.t is None else re.sub(f"^[{X.SPACE}]+|[{X.SPACE}]+\\Z", "", r.t)) and r.q == r.plain


def test_no_recognised_text_is_grouped_or_joined(spark):
    recognized = spark.createDataFrame([(1, 0, "old", "good", 0), (1, 0, "a b c", "weak", 1), (2, 0, "x", "failed", 0)], "doc_id long, page int, text string, ocr_quality string, item_no int")
    probed = enhance.probes(recognized)
    assert "string" not in dict(probed.drop("doc_id").dtypes).values()
    assert {r.doc_id: (r.readable, r.frag, r.n_stripped) for r in probed.collect()} == {1: (0.0, 1.0, 5), 2: (0.0, 1.0, 1)}


def test_merging_keeps_the_first_of_the_best(spark):
    page = "Plain words that were parsed here."
    pages = spark.createDataFrame([(1, 0, page, 34, "parser", False), (1, 1, "", 0, "parser", False), (1, 2, page, 34, "parser", False)], "doc_id long, page_num int, text string, char_count int, content_source string, enhanced boolean")
    none = F.array().cast("array<string>")
    rows = [(1, 0, 0, "ocr", "More words of the page, recognised well.", "good"), (1, 0, 1, "ocr", "? ? |", "weak"), (1, 1, 0, "ocr", " found ", "weak"), (1, 2, 0, "ocr", "? | ?", "weak")]
    fragments = spark.createDataFrame(rows, "doc_id long, page int, fragment_no int, source string, text string, quality string")
    for name in ("visual_type", "formula_summary", "table_summary", "chart_summary", "qa_hint"):
        fragments = fragments.withColumn(name, F.lit(""))
    got = {r.page_num: (r.text, r.content_source) for r in enhance.merge(pages, fragments.withColumn("key_observations", none)).collect()}
    assert got == {0: (f"{page}\n\n[OCR]\nMore words of the page, recognised well.", "ocr"), 1: ("found", "ocr"), 2: (page, "parser")}
