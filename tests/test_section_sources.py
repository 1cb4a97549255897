"""Section texts and their pieces agree, and texts are moved few times."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import analysis, assembly


@pytest.fixture(scope="module")
def sources(spark):
    sections = spark.createDataFrame(
        [("a", "s1", None, None, "g1"), ("a", "slide_2", 0, 1, "g2"), ("a", "slide_02", None, None, None), ("a", "s3", 0, 5, "g3"), ("a", "s4", 1, None, " g4"),
         ("a", "s5", None, None, "g5"), ("b", "slide_1", 1, 0, "")],
        "doc_id string, section_id string, page_start int, page_end int, gist string",
    )
    chunks = spark.createDataFrame([("a", "s1", 2, " two "), ("a", "s1", 1, "w" * 5000), ("a", "s1", 3, "  "), ("a", "s5", 0, " "), ("z", "s1", 0, "stray")], "doc_id string, section_id string, pos int, text string")
    parsed = spark.createDataFrame([("a", "s1", 0, "no"), ("a", "s4", 1, "later"), ("a", "s4", 0, " first "), ("a", "s5", 0, None), ("a", "s5", 1, "second")], "doc_id string, section_id string, section_no int, text string")
    pages = spark.createDataFrame([("a", i, t) for i, t in enumerate(["p0", " ", " p2 ", None, "p4" * 3000])] + [("b", 1, "q1")], "doc_id string, page_num int, text string")
    return sections, chunks, parsed, pages


WANT = {
    ("a", "s1"): ("w" * 5000 + "\n\ntwo", "chunks"), ("a", "slide_2"): ("p2", "slide"), ("a", "slide_02"): ("", "gist"), ("a", "s3"): ("p0\n\np2\n\n" + "p4" * 3000, "pages"),
    ("a", "s4"): ("first", "parsed"), ("a", "s5"): ("g5", "gist"), ("b", "slide_1"): ("q1", "slide"),
}


def test_whole(sources):
    got = {(r.doc_id, r.section_id): (r.text, r.text_source) for r in analysis.section_text(*sources).collect()}
    assert got == WANT


def test_pieces(sources):
    rows = sorted(analysis.section_text_pieces(*sources).collect(), key=lambda r: r.piece_no)
    got = {}
    for r in rows:
        text, source = got.get((r.doc_id, r.section_id), ("", r.text_source))
        assert r.piece_no == len(text) / assembly.PIECE and source == r.text_source
        got[(r.doc_id, r.section_id)] = (text + r.piece, source)
    assert got == {k: v for k, v in WANT.items() if v[0]}


def test_pages_are_joined_once(sources):
    plan = analysis.section_text(*sources)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 1


@pytest.mark.parametrize("sep", ["", "--"])
def test_short_and_long_texts(spark, sep):
    rows = [(g, i, None if i % 5 == 4 else "x" * ((g * i) % 7)) for g in range(9) for i in range(g * 2)] + [(50, 0, ""), (51, 0, None), (51, 1, "")]
    df = spark.createDataFrame(rows, "g int, i long, text string")
    whole = {g: sep.join(t or "" for gg, _, t in sorted(rows, key=lambda r: r[:2]) if gg == g) for g in {r[0] for r in rows}}
    got = assembly.pieces(df, ["g"], "i", sep, size=10).collect()
    assert all(len(r.piece) <= 10 for r in got)
    for g, text in whole.items():
        assert [r.piece for r in sorted(got, key=lambda r: r.piece_no) if r.g == g] == [text[i : i + 10] for i in range(0, len(text), 10)]
