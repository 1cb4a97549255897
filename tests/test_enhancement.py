"""Fragments applied to stored documents; a second run finds nothing to do."""

import pytest
from pyspark.sql import functions as F

from lectern.plans import enhancement
from lectern.sources.store import Store

PAGES = "doc_id string, page_num int, text string, char_count int, content_source string, enhanced boolean, on_image boolean, on_table boolean, on_formula boolean"
FRAGMENTS = "doc_id string, page int, fragment_no int, source string, text string, quality string, reason string, visual_type string, key_observations array<string>, formula_summary string, table_summary string, chart_summary string, qa_hint string"
OCR = "Attention overview with enough OCR text for chunking."


def page(doc, n, text):
    return (doc, n, text, len(text), "parser", False, False, False, False)


def fragment(doc, n, source, text, quality="good"):
    return (doc, n, 0, source, text, quality, "", "", [], "", "", "", "")


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    docs = [("empty", "slides_pdf"), ("caption", "slides_pdf"), ("paper", "research_paper"), ("bad", "slides_pdf"), ("none", "slides_pdf"), ("pageless", "slides_pdf")]
    store.replace("documents", spark.createDataFrame(docs, "doc_id string, doc_subtype string").withColumn("num_chunks", F.lit(3)))
    pages = [page("empty", 2, ""), page("caption", 1, "Existing caption"), page("paper", 0, "First page text."), page("paper", 1, ""), page("bad", 0, "Slide"), page("none", 0, "Slide")]
    store.replace("doc_pages", spark.createDataFrame(pages, PAGES))
    ocr = [fragment("empty", 2, "ocr", OCR), fragment("paper", 1, "ocr", "Second page as recognised text."), fragment("bad", 0, "ocr", "noise", "failed"), fragment("pageless", 0, "ocr", OCR)]
    store.replace("ocr_pages", spark.createDataFrame(ocr, FRAGMENTS))
    store.replace("vision_pages", spark.createDataFrame([fragment("caption", 1, "vision", "Vision explains the diagram.")], FRAGMENTS))
    return store


def rows(answer):
    return {r.doc_id: tuple(r)[1:] for r in answer.collect()}


def segments(store):
    return {s.path for name in ("enhanced_pages", "doc_sections", "chunks", "page_quality", "documents", "derivations") for s in store.log(name).live()}


def test_apply_then_nothing_then_one(spark, store):
    first = rows(enhancement.apply(store))
    assert first == {
        "empty": ("applied", "ocr", 1, 1), "caption": ("applied", "vision", 1, 1), "paper": ("applied", "ocr", 1, 1),
        "bad": ("skipped", "ocr", 0, 3), "none": ("missing", "ocr", 0, 0), "pageless": ("missing", "ocr", 0, 0),
    }
    chunks = {r.doc_id: r.text for r in store.read("chunks").collect()}
    assert OCR in chunks["empty"] and "[VISION]\nVision explains" in chunks["caption"]
    assert chunks["paper"] == "First page text.\n\nSecond page as recognised text."
    assert {r.recommended_action for r in store.read("page_quality", "empty").collect()} == {"keep"}
    assert [(r.title, r.gist) for r in store.read("doc_sections", "empty").collect()] == [("Slide 3", OCR)]
    assert store.read("doc_sections", "paper").collect()[0].title == "Document"
    told = store.read("documents", "empty").collect()[0]
    assert (told.num_chunks, told.num_sections, told.index_status, told.text_quality) == (1, 1, "keyword_only", "weak")
    assert store.read("documents", "none").collect()[0].num_chunks == 3

    before = segments(store)
    second = rows(enhancement.apply(store))
    assert {d: r[0] for d, r in second.items()} == {"empty": "unchanged", "caption": "unchanged", "paper": "unchanged", "bad": "skipped", "none": "missing", "pageless": "missing"}
    assert segments(store) == before

    # new text for one document, and a fragment that loses against what another one has
    store.replace("ocr_pages", spark.createDataFrame([fragment("empty", 2, "ocr", OCR + " And more."), fragment("paper", 1, "ocr", "Second page as recognised text."), fragment("paper", 5, "ocr", "no such page")], FRAGMENTS))
    third = rows(enhancement.apply(store))
    assert {d: r[0] for d, r in third.items() if r[0] == "applied"} == {"empty": "applied"}
    assert third["paper"] == ("unchanged", "ocr", 2, 1)
    added = [s for s in store.log("chunks").live() if s.path not in before]
    assert [r.doc_id for s in added for r in spark.read.parquet(s.path).select("doc_id").collect()] == ["empty"]
    assert "And more." in store.read("chunks", "empty").collect()[0].text
    assert segments(store) - before and rows(enhancement.apply(store))["empty"][0] == "unchanged"


def test_a_run_that_died_is_done_again(spark, store, monkeypatch):
    real = Store.replace

    def dies(self, artifact, changed):
        if artifact == "page_quality":
            raise RuntimeError("lost")
        return real(self, artifact, changed)

    monkeypatch.setattr(Store, "replace", dies)
    with pytest.raises(RuntimeError):
        enhancement.apply(store)
    monkeypatch.setattr(Store, "replace", real)
    assert rows(enhancement.apply(store))["empty"] == ("applied", "ocr", 1, 1)
    assert store.read("chunks", "empty").count() == 1 and store.read("page_quality", "empty").count() == 1


def test_vectors_follow_the_chunks(spark, store):
    enhancement.apply(store, embed=lambda text: F.array(F.length(text).cast("float")))
    got = {r.doc_id: r.embedding[0] for r in store.read("vectors").collect()}
    assert set(got) == {"empty", "caption", "paper"} and got["empty"] >= len(OCR)
    assert store.read("documents", "paper").collect()[0].index_status == "vector"
