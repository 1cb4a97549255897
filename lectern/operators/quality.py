"""Document and page diagnosis. Everything here is column expressions and hash aggregates.

Pages: doc_id, page_num, text, char_count (+ doc_subtype). Lists of pages are returned as
rows, not arrays, so that a document with very many pages stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.functions import measures
from lectern.functions import text as T
from lectern.operators.stage import once


def page_length(char_count: Column, text: Column) -> Column:
    """The stored character count, or the text's length where the count is 0 or missing."""
    return F.coalesce(F.when(char_count != 0, char_count), F.length(text), F.lit(0)).cast("long")


def page_number(*candidates: Column) -> Column:
    """First candidate that reads as a whole number (page, page_num, page_start)."""
    return F.coalesce(
        *[F.when(c.cast("string").rlike("^-?[0-9]+$"), c.cast("string").try_cast("int")) for c in candidates]
    )


def subtype_of(avg_chars: Column, two_column: Column) -> Column:
    return F.when((avg_chars < X.SLIDES_MAX_CHARS) & ~two_column, "slides_pdf").otherwise("research_paper")


def document_subtype(pages: DataFrame) -> DataFrame:
    """slides_pdf where pages are short on average and none has two columns."""
    return pages.groupBy("doc_id").agg(
        F.avg("char_count").alias("avg_chars"),
        F.coalesce(F.bool_or("is_two_column"), F.lit(False)).alias("two_column"),
        F.coalesce(F.bool_or("has_abstract"), F.lit(False)).alias("abstract"),
    ).withColumn("doc_subtype", subtype_of(F.col("avg_chars"), F.col("two_column")))


def text_quality(docs: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Per document: text_quality, ocr_needed, page_text_coverage, section_quality.

    ``docs``: doc_id, raw_len. ``sections``: doc_id, title. A document without pages is
    good from 1000 characters of raw text on and unknown below.
    """
    length = page_length(F.col("char_count"), F.col("text"))
    per_page = pages.select("doc_id", length.alias("n")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.avg("n").alias("avg_chars"),
        F.count_if(F.col("n") >= 80).alias("with_text"),
    )
    titled = sections.groupBy("doc_id").agg(
        F.count_if(F.length(T.strip(F.coalesce("title", F.lit("")))) >= 3).alias("n_titled"),
        F.count(F.lit(1)).alias("n_sections"),
    )
    joined = docs.join(per_page, "doc_id", "left").join(titled, "doc_id", "left")
    none = F.col("n_pages").isNull()
    quality = (
        F.when(none, F.when(F.col("raw_len") >= 1000, "good").otherwise("unknown"))
        .when((F.col("n_pages") >= 3) & (F.col("avg_chars") < 80), "image_based")
        .when((F.col("avg_chars") < 220) | (F.col("raw_len") < 1000), "weak")
        .otherwise("good")
    )
    counted = F.coalesce(F.when(none, F.col("n_sections")).otherwise(F.col("n_titled")), F.lit(0))
    return joined.withColumn("text_quality", quality).select(
        "doc_id",
        "text_quality",
        F.when(none, F.col("text_quality") != "good")
        .otherwise(F.col("text_quality").isin("weak", "image_based"))
        .alias("ocr_needed"),
        F.when(none, F.when(F.col("text_quality") == "good", 1.0).otherwise(0.0))
        .otherwise(T.round_exact(F.col("with_text") / F.col("n_pages"), 2))
        .alias("page_text_coverage"),
        F.when(counted >= 3, "good").when(counted > 0, "weak").otherwise("none").alias("section_quality"),
    )


def visual_flags(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Mark pages that hold an image, a table or a formula.

    ``items``: doc_id, page, kind (image | table | formula), any number per page.
    """
    per_page = items.groupBy("doc_id", F.col("page").alias("page_num")).agg(
        *[F.bool_or(F.col("kind") == kind).alias(f"on_{kind}") for kind in ("image", "table", "formula")]
    )
    joined = pages.join(per_page, ["doc_id", "page_num"], "left")
    for kind in ("image", "table", "formula"):
        joined = joined.withColumn(f"on_{kind}", F.coalesce(F.col(f"on_{kind}"), F.lit(False)))
    return joined


def measured(pages: DataFrame) -> DataFrame:
    """Pages with their text measured and dropped, so that later joins move numbers only."""
    text = F.coalesce("text", F.lit(""))
    counted = once(
        pages,
        {
            "n": page_length(F.col("char_count"), text),
            "symbols": T.symbol_ratio(text),
            "repeats": T.repetition_ratio(text),
            "n_lines": T.line_count(text),
        },
    )
    return counted.select(*[c for c in counted.columns if c != "text"], T.quote(text, 180).alias("text_preview"))


def measured_whole(pages: DataFrame) -> DataFrame:
    """What ``measured`` gives, its text read once: for all pages of a store, where pattern passes are what scoring costs."""
    text = F.coalesce("text", F.lit(""))
    counted = pages.withColumn("n", page_length(F.col("char_count"), text)).withColumn("_length", F.length(text))
    m = F.col("_read")
    read = counted.withColumn("_read", measures.page_measures(180)(F.col("text")))
    repeats = F.when(m["words"] >= 12, F.greatest(F.lit(0.0), F.lit(0.5) - m["distinct"] / m["words"])).otherwise(F.lit(0.0))
    return read.select(
        *[c for c in counted.columns if c not in ("text", "_length")],
        F.when(F.col("_length") > 0, m["symbols"] / F.col("_length")).otherwise(F.lit(0.0)).alias("symbols"),
        repeats.alias("repeats"),
        m["lines"].alias("n_lines"),
        m["preview"].alias("text_preview"),
    )


def page_quality(pages: DataFrame) -> DataFrame:
    """Score pages (with ``doc_subtype`` and visual flags) and say what to do with them.

    Takes pages with text, or better pages already ``measured``.
    """
    if "n_lines" not in pages.columns:
        pages = measured(pages)
    slides = F.col("doc_subtype") == "slides_pdf"
    expected = T.lookup(F.col("doc_subtype"), X.EXPECTED_CHARS, X.EXPECTED_CHARS_DEFAULT)

    known = pages.withColumn("on_visual", F.col("on_image") | F.col("on_table") | F.col("on_formula"))
    scored = once(
        known,
        {
            "ts": T.clamp(T.clamp(F.col("n") / expected) - F.col("symbols") * 0.5 - F.col("repeats") * 0.3),
            "ss": T.clamp(
                F.lit(0.3)
                + F.when(F.col("n_lines") >= 1, 0.25).otherwise(0.0)
                + F.when(F.col("n_lines") >= 2, 0.2).otherwise(0.0)
                + F.when(slides, 0.2).otherwise(0.0)
            ),
            "vs": F.when(F.col("on_visual"), 0.75).otherwise(0.0),
        },
    )
    ts, ss, vs, n = F.col("ts"), F.col("ss"), F.col("vs"), F.col("n")
    sparse = (ts < 0.3) & (vs < 0.2) & (F.col("n_lines") >= 1)
    has_formula_text = F.col("on_formula") & (n >= 20)
    need = (
        F.when(ts < 0.3, 0.45).otherwise(0.0)
        + F.when(vs > 0.4, 0.35).otherwise(0.0)
        + F.when(ss < 0.3, 0.15).otherwise(0.0)
    )
    need = F.when(sparse, F.greatest(F.lit(0.0), need - 0.35)).otherwise(need)
    need = F.when(has_formula_text, F.greatest(F.lit(0.0), need - 0.45)).otherwise(need)
    overall = T.clamp(ts * 0.65 + ss * 0.35)
    overall = F.when((vs > 0.5) & (ts < 0.4), T.clamp(overall - 0.25)).otherwise(overall)
    reasons = F.array_compact(
        F.array(
            F.when(ts < 0.3, "text_low"),
            F.when(vs >= 0.5, "visual_high"),
            F.when(F.col("on_formula") & (n < 20), "formula_signal"),
            F.when(F.col("on_table") & (n < 40), "complex_table_signal"),
            F.when(F.col("on_image") & (n < 20), "diagram_signal"),
            F.when(sparse, "sparse_but_structured"),
            F.when(has_formula_text, "formula_text_available"),
        )
    )
    judged = once(scored, {"need": need, "overall": overall}).withColumn("reasons", reasons)
    action = (
        F.when(has_formula_text, "keep")
        .when((F.col("need") >= 0.5) & (vs > 0.4), "ocr")
        .when((ts < 0.2) & (vs < 0.2), "keep")
        .when((F.col("overall") < 0.35) & (vs > 0.5), "ocr")
        .otherwise("keep")
    )
    return judged.select(
        "doc_id",
        F.concat(F.lit("page_"), F.col("page_num").cast("string")).alias("unit_id"),
        F.when(slides, "slide").otherwise("page").alias("unit_type"),
        F.col("page_num").alias("page_start"),
        F.col("page_num").alias("page_end"),
        T.round_exact(ts, 3).alias("text_score"),
        T.round_exact(ss, 3).alias("structure_score"),
        T.round_exact(vs, 3).alias("visual_score"),
        T.round_exact(T.clamp(F.col("need")), 3).alias("ocr_need_score"),
        T.round_exact(F.col("overall"), 3).alias("overall_score"),
        T.quality_label(F.col("overall")).alias("quality"),
        action.alias("recommended_action"),
        "reasons",
        "text_preview",
    )


def has_content(preview: Column) -> Column:
    flat = T.squeeze(F.coalesce(preview, F.lit("")))
    return (F.length(flat) >= 12) & ~F.lower(flat).isin(*X.BARE_TITLES)


def recommend_from_quality(quality: DataFrame) -> DataFrame:
    """Pages to recognise, with reason. Documents without an ``ocr`` page fall back to
    low-text slides: three slides or more, 60 % of them low, page shows some content."""
    low = F.col("text_score") < 0.35
    slide = F.col("unit_type") == "slide"
    per_doc = quality.groupBy("doc_id").agg(
        F.count_if(F.col("recommended_action") == "ocr").alias("n_ocr"),
        F.count_if(slide).alias("n_slides"),
        F.count_if(slide & low).alias("n_low"),
    )
    fallback = (F.col("n_ocr") == 0) & (F.col("n_slides") >= 3) & (F.col("n_low") / F.col("n_slides") >= 0.6)
    asked = F.col("recommended_action") == "ocr"
    reason = F.when(
        asked,
        F.when(F.array_contains("reasons", "visual_high"), "text_low_parser_visuals").otherwise("document_image_based"),
    ).when(slide & low & F.col("fallback") & has_content(F.col("text_preview")), "document_low_text_slides")
    flags = per_doc.where((F.col("n_ocr") > 0) | fallback).select("doc_id", fallback.alias("fallback"))
    return (
        quality.select("doc_id", "page_start", "recommended_action", "unit_type", "text_score", "text_preview", "reasons")
        .join(flags, "doc_id")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("doc_id", F.col("page_start").alias("page"), "reason")
    )


def recommend_from_counts(pages: DataFrame) -> DataFrame:
    """Pages to recognise from raw character counts (+ ``on_visual``, ``visual_density``).

    A slide document of three pages or more that is mostly near-empty is image based:
    all its low-text pages are taken.
    """
    n = page_length(F.col("char_count"), F.col("text"))
    counted = pages.withColumn("n", n)
    per_doc = counted.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("n") < X.LOW_TEXT_CHARS).alias("n_low"),
        F.count_if(F.col("n") <= X.NEAR_EMPTY_CHARS).alias("n_empty"),
    ).where(F.col("n_low") > 0)
    image_based = (
        (F.col("doc_subtype") == "slides_pdf")
        & (F.col("n_pages") >= 3)
        & (F.col("n_low") / F.col("n_pages") >= 0.6)
        & (F.col("n_empty") / F.col("n_pages") >= 0.5)
    )
    reason = (
        F.when(image_based, "document_image_based")
        .when(F.col("on_visual"), "text_low_parser_visuals")
        .when(F.coalesce("visual_density", F.lit(0.0)) >= X.VISUAL_DENSITY, "text_low_visual_high")
    )
    return (
        counted.where(F.col("n") < X.LOW_TEXT_CHARS)
        .join(per_doc, "doc_id")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("doc_id", F.col("page_num").alias("page"), "reason")
    )


def recognition_quality(text: Column, density: Column, kind: Column) -> Column:
    """struct(ocr_quality, vision_recommended, reason, usable_text) of recognised text."""
    usable = T.squeeze(F.coalesce(text, F.lit("")))
    n = F.length(usable)
    dense = density >= X.VISUAL_DENSITY
    verdict = lambda q, r: F.struct(
        F.lit(q).alias("ocr_quality"), F.lit(q != "good").alias("vision_recommended"), F.lit(r).alias("reason")
    )
    chosen = (
        F.when((n < 8) & dense, verdict("weak", "ocr_too_short_visual_high"))
        .when(n < 8, verdict("failed", "ocr_too_short"))
        .when(T.symbol_ratio(usable, empty=1.0) >= 0.55, verdict("failed", "garbled_text"))
        .when(kind.isin("diagram", "chart", "formula", "flow"), verdict("weak", "diagram_like"))
        .when((n < 40) & dense, verdict("weak", "ocr_too_short_visual_high"))
        .otherwise(verdict("good", "ocr_text_usable"))
    )
    return F.struct(
        chosen["ocr_quality"].alias("ocr_quality"),
        chosen["vision_recommended"].alias("vision_recommended"),
        chosen["reason"].alias("reason"),
        usable.alias("usable_text"),
    )


def job_status(pages: DataFrame, quality_col: str) -> DataFrame:
    """A recognition job failed only if all its pages failed."""
    return pages.groupBy("doc_id").agg(
        F.when(F.bool_and(F.col(quality_col) == "failed"), "failed").otherwise("completed").alias("status"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def merge_model_quality(quality: DataFrame, judged: DataFrame) -> DataFrame:
    """Model verdicts override four columns of matching units; unknown units are appended.

    ``judged``: doc_id, unit_id, item_no, llm_score, quality, recommended_action, llm_reason; a
    null there leaves the heuristic value. Of several verdicts the last (``item_no``) counts.
    """
    said = F.struct("llm_score", "quality", "recommended_action", "llm_reason")
    last = judged.groupBy("doc_id", "unit_id").agg(F.max_by(said, "item_no").alias("v")).select("doc_id", "unit_id", "v.*")
    q, j = quality.alias("q"), last.alias("j")
    return q.join(
        j, (F.col("q.doc_id") == F.col("j.doc_id")) & (F.col("q.unit_id") == F.col("j.unit_id")), "full_outer"
    ).select(
        F.coalesce("q.doc_id", "j.doc_id").alias("doc_id"),
        F.coalesce("q.unit_id", "j.unit_id").alias("unit_id"),
        F.col("q.overall_score").alias("overall_score"),
        F.col("j.llm_score").alias("llm_score"),
        F.coalesce("j.quality", "q.quality").alias("quality"),
        F.coalesce("j.recommended_action", "q.recommended_action").alias("recommended_action"),
        F.col("j.llm_reason").alias("llm_reason"),
    )


def analysis_status(docs: DataFrame, quality: DataFrame, recommended: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Fallback analysis of documents without a stored one: state of their parse."""
    weak = F.col("quality").isin("weak", "failed") | F.col("recommended_action").isin("ocr", "vision")
    per_doc = quality.groupBy("doc_id").agg(F.count_if(weak).alias("n_weak"), F.count(F.lit(1)).alias("n_units"))
    rec = recommended.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_recommended"))
    enh = enhanced.groupBy("doc_id").agg(F.bool_or("enhanced").alias("any_enhanced"))
    joined = docs.join(per_doc, "doc_id", "left").join(rec, "doc_id", "left").join(enh, "doc_id", "left")
    status = (
        F.when(F.coalesce("any_enhanced", F.lit(False)), "enhanced_completed")
        .when((F.coalesce("n_weak", F.lit(0)) > 0) | (F.coalesce("n_recommended", F.lit(0)) > 0), "needs_enhancement")
        .otherwise("usable")
    )
    return joined.select(
        "doc_id",
        F.when(F.col("n_units").isNull(), "unavailable").otherwise("available").alias("status"),
        F.when(F.col("n_units").isNotNull(), status).alias("parse_quality_status"),
        F.coalesce("n_weak", F.lit(0)).alias("n_weak"),
    )


def weak_pages(quality: DataFrame, most: int = 8) -> DataFrame:
    """The first weak pages of a document, labelled from 1."""
    from lectern.operators.ranking import top_k

    weak = quality.where(
        F.col("quality").isin("weak", "failed") | F.col("recommended_action").isin("ocr", "vision")
    )
    return top_k(weak, ["doc_id"], [F.col("page_start")], most, "nth").withColumn("page_no", F.col("page_start") + 1)
