"""Notation, cross-references and empty tables: one pass over a text, and nothing planned for what is not there."""

from pyspark.sql import functions as F

from lectern.functions import fixed as X
from lectern.functions import notation
from lectern.functions import text as T
from lectern.operators import chunking
from lectern.operators.stage import nothing


def test_one_pass_gives_norm_symbols_and_keywords():
    assert notation.read_notation("x1 = \\alpha_2 · Q^T") == ("x 1 = alpha 2 dot Q transpose", ["x", "1", "alpha", "2", "dot", "q"], True)
    assert notation.read_notation(None) == ("", [], False)
    assert notation.read_notation("ﬁne  x x 2ab") == ("fine x x 2 ab", ["x", "2"], False)


def test_cross_refs_as_by_the_pattern_alone(spark):
    texts = ["see FIG. 3 and eq (4)", "Section. 2.1", "a plain text 12", "unequal Table 9", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select(T.cross_refs(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(X.CROSS_REF), F.lit(1)).alias("b")).collect():
        assert r.a == r.b


def test_units_without_sections_are_planned_without_joins(spark):
    docs = spark.createDataFrame([(1, "research_paper", "some text")], "doc_id long, doc_subtype string, raw_text string")
    columns = "doc_id bigint, section_no int, section_id string, title string, text string, page_start int, page_end int, content_source string, enhanced boolean"
    units = chunking.paper_units(docs, nothing(spark, columns))
    assert "Join" not in units._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in units.collect()] == ["some text"]
