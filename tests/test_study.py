"""Briefs read from answers of every kind, concept maps, and memory that is cleared in a store."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.plans import analysis_response, answer, briefs, forget
from lectern.sources.store import Store

WHOLE = {
    "tldr": ["a", "b"], "problem": "p", "motivation": "m", "contributions": [{"claim": "c", "why_it_matters": "w"}],
    "method_walkthrough": [{"title": "t", "explanation": "e", "evidence": "  said so  "}],
    "reading_focus": [{"section_id": "s", "section_title": "S", "reason": "r"}], "review_questions": [{"question": "q"}], "limitations": ["l"],
}


def read(spark, answers):
    rows = spark.createDataFrame([(i, a if a is None or isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)], "n int, answer string")
    return [(r.brief, r.error) for r in briefs.parsed(rows).orderBy("n").collect()]


def test_whole_brief_and_evidence(spark):
    [(b, error)] = read(spark, [WHOLE])
    assert error == "" and b.brief_type == "paper" and b.tldr == ["a", "b"] and b.contributions[0].evidence is None
    assert b.method_walkthrough[0].evidence.quote == "said so" and b.review_questions[0].level == "basic" and b.reading_focus[0].reason == "r"
    long = {"contributions": [{"claim": "c", "evidence": "x" * 500}, {"claim": "d", "evidence": " "}, {"claim": "e", "evidence": {"quote": "q"}}, {"claim": "f", "evidence": None}]}
    [(b, _)] = read(spark, [long])
    assert [c.evidence and c.evidence.quote for c in b.contributions] == ["x" * 260, None, "q", None]


def test_core_concepts_of_a_lecture(spark):
    core = {"core_concepts": [{"claim": "k"}]}
    got = read(spark, [core, core | {"brief_type": "lecture"}, core | {"brief_type": "lecture", "contributions": []}])
    assert [[c.claim for c in b.contributions] for b, _ in got] == [[], ["k"], []]


@pytest.mark.parametrize(
    "wrong, field",
    [({"contributions": [{"why_it_matters": "w"}]}, "contributions"), ({"tldr": "text"}, "tldr"), ({"tldr": [1]}, "tldr"), ({"problem": None}, "problem"), ({"limitations": None}, "limitations"),
     ({"method_walkthrough": [{"title": "t"}]}, "method_walkthrough"), ({"reading_focus": [{"section_id": "s"}]}, "reading_focus"), ({"review_questions": ["q"]}, "review_questions"),
     ({"brief_type": 3}, "brief_type"), ({"contributions": [{"claim": "c", "evidence": {"quote": 1}}]}, "contributions")],
)
def test_wrong_fields_make_no_brief(spark, wrong, field):
    [(b, error)] = read(spark, [WHOLE | wrong])
    assert b is None and error == f"not as asked: {field}"


def test_lenient_lists_and_answers_without_json(spark):
    got = read(spark, [WHOLE | {"contributions": "none", "method_walkthrough": [1, {"title": "t", "explanation": "e"}]}, "no", "", None, "[1]", "```json\n{}\n```", "so {\"problem\": \"x\"} it is"])
    assert got[0][1] == "" and got[0][0].contributions == [] and len(got[0][0].method_walkthrough) == 1
    assert all(b is None and error == "no JSON object in the answer" for b, error in got[1:5])
    assert got[5][1] == "" and got[5][0].problem == "" and got[6][0].problem == "x"


def test_failed_generation_keeps_the_stored_brief(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("documents", spark.createDataFrame([("a", "A", "slides_pdf", "good", False), ("b", None, None, None, None)], "doc_id string, name string, doc_subtype string, text_quality string, ocr_needed boolean"))
    ask = lambda *rows: spark.createDataFrame(list(rows), "request_id string, doc_id string, force boolean").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))

    def serve(rows, slot=None):
        return {r.request_id: r for r in briefs.serve(store, ask(*rows), slot).collect()}

    def answering(said):  # no name of this module, which workers cannot import
        return lambda prompts: [said] * len(prompts)

    rows = [("1", "a", True), ("2", "a", None), ("3", "x", True), ("4", None, False), ("5", "a", True)]
    first = serve(rows, answering(json.dumps(WHOLE)))
    assert {k: r.source for k, r in first.items()} == {"1": "llm", "2": "not_generated", "3": None, "4": None, "5": "llm"}
    assert first["3"].error == first["4"].error == "Document not found" and first["1"].brief_type == "lecture"
    failed = serve([("1", "a", True), ("2", "a", False), ("3", "b", False)], answering("no"))
    assert failed["1"].source == "unavailable" and failed["1"].error.endswith("no JSON object in the answer")
    assert failed["2"].source == "cached" and failed["2"].brief.problem == "p" and failed["3"].brief_type == "paper"
    assert serve([("1", "a", False)])["1"].source == "cached"
    kinds = sorted(r.event_type for r in store.read("learning_events").collect())
    assert kinds == ["brief_generate"] * 3 + ["brief_view"] * 2


def test_concept_map_levels_and_titles(spark):
    docs = spark.createDataFrame([("d/1",), ("e",)], "doc_id string")
    rows = [("d/1", i, f"i{i}", t, level) for i, (t, level) in enumerate([("A", 1), ("B [x]", 2), ('C "q"', 4), ("", 3), ("E", None), ("F", 3)])]
    got = {r.doc_id: r for r in answer.concept_map(docs, spark.createDataFrame(rows, "doc_id string, section_no int, section_id string, title string, level int")).collect()}
    assert got["d/1"].map_name == "d_1_concepts.md" and 's2["B (x)"]' in got["d/1"].map_text and "s3[\"C 'q'\"]" in got["d/1"].map_text and 's4["i3"]' in got["d/1"].map_text
    assert [line.strip() for line in got["d/1"].map_text.split("\n") if "-->" in line] == ["doc --> s1", "s1 --> s2", "doc --> s3", "s2 --> s4", "doc --> s5", "doc --> s6"]
    assert 'empty["No extracted sections"]' in got["e"].map_text


def test_cleared_artifacts_take_new_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    forget.everything(store)  # nothing is stored yet
    one = spark.createDataFrame([("a", 1)], "doc_id string, n int")
    store.append("learning_events", one)
    store.replace("learning_events", one)
    forget.session(store)
    assert store.read("learning_events").count() == 0 and store.exists("learning_events")
    store.append("learning_events", one)
    assert store.read("learning_events").count() == 1
    store.compact("learning_events", most=0)
    store.vacuum("learning_events")
    assert store.read("learning_events").collect() == one.collect()


def test_analysis_of_an_empty_store_and_of_a_bare_one(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    asked = spark.createDataFrame([("a",), ("a",), (None,)], "doc_id string")
    assert {r.status for r in analysis_response.responses(store, asked).collect()} == {"missing"}
    store.replace("documents", spark.createDataFrame([("a",)], "doc_id string"))
    store.replace("page_quality", spark.createDataFrame([("a", i, "weak", None) for i in range(20)], "doc_id string, page_start int, quality string, recommended_action string"))
    got = [r for r in analysis_response.responses(store, asked).collect() if r.doc_id]
    assert len(got) == 2 and all(r.parse_quality_status == "needs_enhancement" and [p.page for p in r.pages] == list(range(8)) for r in got)
    assert got[0].pages[0].recommended_action == "keep" and got[0].actions == [analysis_response.FINE]
