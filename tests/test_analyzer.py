"""Texts for the analyzer cut from page rows, and its answers."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import analyzer


def test_windows_like_slices_of_the_text(spark):
    texts = {1: ["alpha " * 900, "", "beta title here", "gamma " * 2000], 2: ["short"], 3: ["", ""], 4: ["é漢𝔘" * 3000]}
    pages = spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, page_num int, text string")
    asked = [(0, "x", None), (1, "beta title", None), (2, "nowhere", None), (3, "t", 0), (4, "t", 1), (5, "t", 4), (6, "t", 900), (7, "", None), (8, None, None), (9, "a", 2), (10, "left out", 0)]
    sections = spark.createDataFrame([(d, no, str(no), t, p) for d in texts for no, t, p in asked], "doc_id long, section_no int, section_id string, title string, page_start int")
    got = {(r.doc_id, r.section_no): r for r in analyzer.section_windows(pages, sections).collect()}
    assert len(got) == 10 * len(texts)
    for d, ts in texts.items():
        text = "\n".join(ts)
        for no, title, page in asked[:10]:
            if page is not None:
                want = text[max(0, page * 3000 - 500) : min(len(text), page * 3000 + 3500)]
            elif (at := text.find(title or "")) >= 0 and title:
                want = text[max(0, at - 200) : min(len(text), at + 3000)]
            else:
                want = text[:3000]
            r = got[d, no]
            assert (r.window, r.l0_text, r.l1_text) == (want, want[:2000], want[:5000]), (d, no)
    first = {r.doc_id: r.excerpt for r in analyzer.opening(pages).collect()}
    assert first == {d: "\n".join(ts)[:8000] for d, ts in texts.items()}


def read(spark, *said):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "doc_id long, answer string")
    return df.select("doc_id", analyzer.parsed_answer(F.col("answer")).alias("understanding"))


def test_answers_of_every_kind(spark):
    full = {"doc_type": "slides", "difficulty": "advanced", "estimated_reading_time": 45, "sections": [{"id": "7", "title": "Intro", "page_start": 1}, {"title": "Next", "level": 2}], "key_terms": [{"english": "a", "chinese": "b"}], "l0_summaries": {"1": "x"}, "prerequisites": ["p"]}
    said = read(spark, f"```json\n{json.dumps(full)}\n```", "{}", None, "no json", "[1, 2]", '{"sections": "none", "language": "fr"}')
    got = [r.understanding for r in said.orderBy("doc_id").collect()]
    assert [r.error == "" for r in got] == [True, False, False, False, False, True]
    assert (got[0].doc_type, got[0].difficulty, got[0].estimated_reading_time, got[0].prerequisites, got[0].l0_summaries) == ("slides", "advanced", 45, ["p"], {"1": "x"})
    assert [(s.section_id, s.title, s.level, s.section_type) for s in got[0].sections] == [("7", "Intro", 1, "prose"), ("1", "Next", 2, "prose")]
    assert (got[5].language, got[5].doc_type, got[5].sections) == ("fr", "research_paper", None)
    parsed = spark.createDataFrame([(0, 0, "p", "P", 1, 1, 2), (5, 0, None, None, None, None, None), (3, 0, "p", "P", 1, 1, 2)], "doc_id long, section_no int, section_id string, title string, level int, page_start int, page_end int")
    merged = analyzer.merged_sections(said, parsed).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.section_id, r.title, r.origin) for r in merged] == [(0, "7", "Intro", "model"), (0, "1", "Next", "model"), (5, "0", "", "parser")]


@pytest.mark.parametrize("wrap", ["{}", "```json\n{}\n```"])
def test_terms_need_a_list(spark, wrap):
    terms = [{"english": f"e{i}", "chinese": "" if i == 3 else f"c{i}"} for i in range(25)]
    said = spark.createDataFrame([(wrap.replace("{}", json.dumps(terms)),), ('{"english": "e", "chinese": "c"}',), ("broken",), (None,)], "answer string")
    got = [[t.english for t in r.t] for r in said.select(analyzer.listed_terms(F.col("answer")).alias("t")).collect()]
    assert got == [[f"e{i}" for i in range(20) if i != 3], [], [], []]
