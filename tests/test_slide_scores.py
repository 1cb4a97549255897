"""Scores and chunks of a store's pages: a text is read once, and blocks are cut only where they decide."""

import re

from pyspark.sql import functions as F

from lectern.functions import fixed as X
from lectern.functions import notation
from lectern.functions import text as T
from lectern.operators import chunking, quality

TEXTS = [
    "", " ", "a", " a  b \n\x0b c ", "\n", "x" * 500, "A b " * 7, "A b a B \n" * 60, "ä! 1 \U0001d6fc ?", "é́ ½ _x_ 中文 [OCR]", "one\r\ntwo\x85\x1cthree   four",
    " " * 900 + "x" + " " * 900 + "y " * 300, "ab " * 400 + "." * 300, "x = y", "log of a softmax", "a - b", "$1", None,
]


def test_pages_read_once_have_the_scores_of_the_patterns(spark):
    rows = spark.createDataFrame([(i, i, t, 7 if i % 3 == 0 else None) for i, t in enumerate(TEXTS)], "doc_id int, page_num int, text string, char_count int")
    columns = ["doc_id", "page_num", "char_count", "n", "symbols", "repeats", "n_lines", "text_preview"]
    plain, read = (f(rows).select(*columns) for f in (quality.measured, quality.measured_whole))
    assert read.dtypes == plain.dtypes and sorted(read.collect()) == sorted(plain.collect())
    assert "regexp" not in quality.measured_whole(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_only_formulas_are_read_to_the_end():
    for text in TEXTS:
        norm, syms, keyword = notation.read_notation(text)
        several = len(syms) >= 2
        formula = bool(text) and bool(keyword or re.search(r"[$\\]", text) or re.search(X.MATH_OPERATORS, text) or (several and re.search(X.MATH_LIKE, text)))
        assert notation.read_formula(text) == ((norm, syms, True) if formula else ("", [], False))


def test_a_slide_that_fits_is_not_cut_into_blocks(spark):
    long = "\n\n".join(["A line that is told at some length and is no title of anything at all."] * 40)
    columns = "unit_no int, text string, courseware boolean, max_tokens int, overlap int"
    units = spark.createDataFrame([(0, " One\n\ntwo ", True, 500, 50), (1, long, True, 500, 50), (2, "# A\n\none\n\n# B\n\ntwo", False, 500, 50), (3, "one\n\ntwo", False, 500, 50)], columns)
    cut = chunking.with_blocks(units, wanted=F.col("unit_no") > 0).select("unit_no", "blocks").collect()
    assert [r.unit_no for r in cut if r.blocks is None] == [0]
    made = {(r.unit_no, r.chunk_no): r.text for r in chunking.chunk_texts(units).collect()}
    assert made[0, 0] == "One\n\ntwo" and made[3, 0] == "one\n\ntwo" and made[2, 0] == "# A\n\none" and made[2, 1] == "# B\n\ntwo"
    assert (1, 1) in made and made[1, 0].startswith("A line")


def test_markup_as_by_the_pattern_alone(spark):
    rows = spark.createDataFrame([(t,) for t in ["$x$", "a $ b", "\\begin{equation}x\\end{equation}", "\\begin{align}", "plain", "", None]], "t string")
    for r in rows.select(T.has_formula_markup(F.col("t")).alias("a"), F.col("t").rlike(X.FORMULA_MARKUP).alias("b")).collect():
        assert r.a == r.b
