import random

from pyspark.sql import functions as F

from lectern.functions import notation
from lectern.functions import text as T
from lectern.operators import chunking


def cost(s):
    return chunking._cost(*chunking._measure(s))


def test_windows_cover_all_words_and_fit():
    rng = random.Random(5)
    for _ in range(50):
        words = ["x" * rng.randint(1, 12) for _ in range(rng.randint(2, 300))]
        limit, overlap = rng.randint(5, 40), rng.randint(1, 12)
        pieces = list(chunking._windows(words, limit, overlap))
        assert all(cost(p) <= limit or " " not in p for p in pieces)
        joined = pieces[0].split()
        for before, after in zip(pieces, pieces[1:]):
            b, a = before.split(), after.split()
            shared = min(overlap, len(b) - 1)
            assert a[:shared] == b[len(b) - shared :]
            joined += a[shared:]
        assert joined == words


def test_text_without_blanks_is_cut_by_characters():
    pieces = chunking.fill_chunks(["X" * 3000], ["prose"], 100, 10)
    assert [len(p) for p in pieces[:2]] == [400, 400]
    assert pieces[-1].endswith("X") and len(pieces) == len(range(0, 3000, 380))


def test_heading_starts_a_chunk_and_overlap_leads_the_next():
    body = " ".join(f"w{i}" for i in range(60))
    out = chunking.fill_chunks(["intro words", "## A\n\n" + body, body], ["prose", "heading", "prose"], 70, 3)
    assert out[0] == "intro words"
    assert out[1].startswith("## A")
    assert out[2].startswith("w57 w58 w59\n\nw0")


def test_blocks_bind_titles(spark):
    text = "# Title\n\nBody text.\n\n- a\n- b\n\nFigure 2: Shown\n\nmore prose\n\n$$x$$\n\n4 Results"
    long = "A thing that is told at such length that nobody could take it for the short title of a slide."
    slides = f"Short title\n\n- one\n- two\n\nDefinition:\n\n{long}\n\nNote\n\nBrief."
    df = spark.createDataFrame([(text, False), (slides, True)], "text string, courseware boolean")
    rows = chunking.with_blocks(df).select("courseware", "blocks").collect()
    found = {r.courseware: [(b.kind, b.text) for b in r.blocks] for r in rows}
    assert found[False] == [
        ("heading", "# Title\n\nBody text."),
        ("list", "- a\n- b"),
        ("caption", "Figure 2: Shown\n\nmore prose"),
        ("formula", "$$x$$"),
        ("heading", "4 Results"),
    ]
    # a short line counts as a title itself, so a label before it stays alone
    assert found[True] == [
        ("slide_title", "Short title\n\n- one\n- two"),
        ("teaching_label", f"Definition:\n\n{long}"),
        ("teaching_label", "Note"),
        ("slide_title", "Brief."),
    ]


def test_references_are_left_out_and_positions_are_dense(spark):
    docs = spark.createDataFrame([(1, "research_paper", "raw")], "doc_id long, doc_subtype string, raw_text string")
    rows = [
        (1, 0, "1.1", "Method", "alpha beta", 0, 0, "parser", False),
        (1, 1, "2", "References", "[1] gone", 1, 1, "parser", False),
        (1, 2, "3", "Results", "gamma", 2, 2, "parser", False),
    ]
    sections = spark.createDataFrame(
        rows,
        "doc_id long, section_no int, section_id string, title string, text string, page_start int, page_end int, "
        "content_source string, enhanced boolean",
    )
    out = chunking.chunk(chunking.paper_units(docs, sections)).orderBy("pos").collect()
    assert [(r.pos, r.chunk_id, r.metadata.section_type, r.metadata.chapter) for r in out] == [
        (0, "1_1.1_0", "method", "1"),
        (1, "1_3_0", "results", "3"),
    ]


def test_documents_without_a_title_are_chunked_whole(spark):
    docs = spark.createDataFrame(
        [(1, "research_paper", "Method\nalpha beta"), (2, "research_paper", "nothing to be found here"), (3, "research_paper", " ")],
        "doc_id long, doc_subtype string, raw_text string",
    )
    toc = spark.createDataFrame([(1, 1, "Method"), (2, 1, "Nowhere"), (3, 1, "Gone")], "doc_id long, section_no int, title string")
    out = chunking.chunk_by_titles(docs, toc).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.chunk_id, r.text) for r in out] == [
        (1, 0, "1_1_1_0", "Method\nalpha beta"),
        (2, 0, "2_0_0", "nothing to be found here"),
    ]


def test_last_verdict_counts(spark):
    from lectern.operators import quality

    scored = spark.createDataFrame([(1, "u", 0.4, "weak", "ocr")], "doc_id long, unit_id string, overall_score double, quality string, recommended_action string")
    said = spark.createDataFrame(
        [(1, "u", 1, 0.9, "good", None, "b"), (1, "u", 0, 0.1, "failed", "ocr", "a"), (1, "new", 0, 0.5, "good", "keep", "c")],
        "doc_id long, unit_id string, item_no int, llm_score double, quality string, recommended_action string, llm_reason string",
    )
    rows = {r.unit_id: tuple(r) for r in quality.merge_model_quality(scored, said).collect()}
    assert rows == {"u": (1, "u", 0.4, 0.9, "good", "ocr", "b"), "new": (1, "new", None, 0.5, "good", "keep", "c")}


def test_slides_fall_back_to_sections(spark):
    docs = spark.createDataFrame([("d", "slides_pdf", "")], "doc_id string, doc_subtype string, raw_text string")
    pages = spark.createDataFrame(
        [("d", 0, 0, "  ", "parser", False)],
        "doc_id string, page_num int, page_no int, text string, content_source string, enhanced boolean",
    )
    sections = spark.createDataFrame(
        [("d", 0, "", "Intro", "Body", 4, 4, "", False)],
        "doc_id string, section_no int, section_id string, title string, text string, page_start int, page_end int, "
        "content_source string, enhanced boolean",
    )
    (row,) = chunking.chunk(chunking.slide_units(docs, pages, sections)).collect()
    assert row.chunk_id == "d_slide_0_0" and row.text == "Intro\n\nBody"
    assert row.metadata.content_type == "slide" and row.metadata.chapter == "1"


def test_facts_hold_numbers():
    text = "No figures here. It scored 41 points. " + "Filler words only. " * 60
    facts = chunking._fact_groups(text, 20)
    assert len(facts) == 1 and "41 points" in facts[0]


def test_notation(spark):
    df = spark.createDataFrame([("𝛼 = 𝒒∙𝒌, 𝑊𝑞",), ("Plain words only here",), ("x^T \\alpha",)], "text string")
    rows = {r.text: r for r in notation.with_notation(df, "text").collect()}
    first = rows["𝛼 = 𝒒∙𝒌, 𝑊𝑞"]
    assert first.math_has_formula and "alpha" in first.math_normalized and "q dot k" in first.math_formula_ids
    assert not rows["Plain words only here"].math_has_formula
    assert "transpose" in rows["x^T \\alpha"].math_normalized


def test_round_exact_is_pythons_round(spark):
    rng = random.Random(1)
    values = [rng.random() * 10 for _ in range(2000)] + [i / 2000 for i in range(2000)] + [2.675, 0.1235, 0.0625]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        got = df.select("v", T.round_exact(F.col("v"), digits).alias("r")).collect()
        assert all(r.r == round(r.v, digits) for r in got)


def test_wide_characters(spark):
    df = spark.createDataFrame([("图 Figure 注意力",), ("plain",)], "t string")
    got = df.select(T.estimate_tokens(F.col("t")).alias("n"), T.question_intent(F.col("t")).alias("i"), T.tokens(F.col("t")).alias("k")).collect()
    assert (got[0].n, got[0].i, got[0].k) == (2 + 2, "figure", ["图", "figure", "注", "意", "力"])
