"""Applying recognised and vision text to stored documents, as a rebuild driven by change.

What is derived from a document (merged pages, sections, chunks, quality, vectors, summary) is
kept with two keys. The *input key* is a digest of its pages and fragments; the *content key* is one
of its merged pages. A run merges the documents whose input key has changed, and of these it
chunks, scores, summarises and indexes only the ones whose content key has changed. The keys are sums
and xors of row hashes, so they combine map-side and no text is shuffled to find out what to do.

All results go into the store as segments of the changed documents, the keys last: a run that
dies is done again by the next one, and a run without changes writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T
from lectern.operators import chunking, enhance, quality
from lectern.operators.stage import alone, nothing, passing, written
from lectern.sources.store import Store

#: Part of every content key: a new number rebuilds all.
RULES = 1
GIST = 200
FLAGS = ("on_image", "on_table", "on_formula")
_NO_SECTIONS = "doc_id string, section_no int, section_id string, title string, text string, page_start int, page_end int, content_source string, enhanced boolean"


def _digest(*columns: str) -> list[Column]:
    """Three numbers that stand for a set of rows, whatever their order."""
    one, two = F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)
    return [F.count(F.lit(1)).alias("_n"), F.bit_xor(one).alias("_x"), F.sum(F.shiftright(two, 16)).alias("_s")]


def row_set_key(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(doc_id, ``name``): a digest of each document's rows."""
    return rows.groupBy("doc_id").agg(*_digest(*columns)).select("doc_id", F.concat_ws(":", "_n", F.hex("_x"), F.hex("_s")).alias(name))


def _fragments(store: Store) -> DataFrame | None:
    found = [store.read(name) for name in ("ocr_pages", "vision_pages") if store.exists(name)]
    if not found:
        return None
    return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)


def standing(store: Store) -> DataFrame:
    """One row per document: what there is to apply, and whether it was applied already.

    doc_id, num_chunks, source, num_pages_updated, status (missing, skipped, current, stale), input_key.
    """
    known = ["num_chunks"] if "num_chunks" in store.read("documents").columns else []
    docs = store.read("documents").select("doc_id", *known)
    pages = store.read("doc_pages")
    fragments = _fragments(store)
    old = store.read("derivations").select("doc_id", F.col("input_key").alias("_old")) if store.exists("derivations") else None
    base = row_set_key(pages, ["page_num", "text", "content_source", *FLAGS], "_pages")
    if fragments is None:
        facts = docs.select("doc_id").where("false").select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("_ocr", "boolean"), ("_vision", "boolean"), ("_updated", "long"), ("_fragments", "string"))])
    else:
        text = enhance.fragment_text(F.col("source"), F.col("text"))
        usable = (F.col("quality") != "failed") & (text != "")
        facts = fragments.groupBy("doc_id").agg(
            F.bool_or(F.col("source") == "ocr").alias("_ocr"),
            F.bool_or(F.col("source") == "vision").alias("_vision"),
            F.count_distinct(F.when(usable, F.col("page"))).alias("_updated"),
        ).join(row_set_key(fragments, [c for c in enhance.FRAGMENT_COLUMNS if c in fragments.columns and c != "doc_id"], "_fragments"), "doc_id")
    joined = docs.join(base, "doc_id", "left").join(facts, "doc_id", "left")
    joined = joined.join(old, "doc_id", "left") if old is not None else joined.withColumn("_old", F.lit(None).cast("string"))
    key = F.concat_ws("|", F.lit(str(RULES)), "_pages", "_fragments")
    status = (
        F.when(F.col("_fragments").isNull() | F.col("_pages").isNull(), "missing")
        .when(F.col("_updated") == 0, "skipped")
        .when(F.col("_old").eqNullSafe(key), "current")
        .otherwise("stale")
    )
    source = F.when(F.col("_ocr") & F.col("_vision"), "mixed").when(F.col("_vision"), "vision").otherwise("ocr")
    return joined.select(
        "doc_id",
        F.coalesce(F.col("num_chunks") if known else F.lit(0), F.lit(0)).cast("long").alias("num_chunks"),
        status.alias("status"),
        F.when(status == "missing", "ocr").otherwise(source).alias("source"),
        F.when(status.isin("missing", "skipped"), 0).otherwise(F.col("_updated")).cast("long").alias("num_pages_updated"),
        key.alias("input_key"),
    )


def default_chunks(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Slides one by one; other documents as one text made of their pages."""
    none = nothing(docs.sparkSession, _NO_SECTIONS)
    slides = chunking.slide_units(docs, pages.withColumn("page_no", F.col("page_num")), none)
    papers = docs.where(F.col("doc_subtype") != "slides_pdf")
    raw = papers.join(enhance.raw_text(pages.join(papers.select("doc_id"), "doc_id", "left_semi")), "doc_id")
    return chunking.chunk(slides.unionByName(chunking.paper_units(raw, none)))


def sections_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Section summaries: a slide with text each, or one for a whole document."""
    gist = F.left("text", F.lit(GIST)).alias("gist")
    slides = enhance.slide_sections(pages.join(docs.where(F.col("doc_subtype") == "slides_pdf").select("doc_id"), "doc_id", "left_semi"))
    by_slide = slides.select("doc_id", "section_id", "title", "level", "page_start", "page_end", gist)
    first = pages.join(docs.where(F.col("doc_subtype") != "slides_pdf").select("doc_id"), "doc_id", "left_semi")
    body = T.strip(F.coalesce("text", F.lit("")))
    # the first 200 characters of the joined text stand in the first 200 non-blank pages at most
    heads = first.where(body != "").select("doc_id", "page_num", F.left(body, F.lit(GIST)).alias("text"))
    from lectern.operators.ranking import top_k

    raw = enhance.raw_text(top_k(heads, ["doc_id"], [F.col("page_num")], GIST, "_n"))
    whole = raw.select(
        "doc_id", F.lit("0").alias("section_id"), F.lit("Document").alias("title"), F.lit(1).alias("level"),
        F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.left("raw_text", F.lit(GIST)).alias("gist"),
    )
    return by_slide.unionByName(whole)


def summary_of(docs: DataFrame, pages: DataFrame, sections: DataFrame, scored: DataFrame) -> DataFrame:
    """What the documents table says about a document after a rebuild."""
    length = T.strip(F.coalesce("text", F.lit("")))
    raw_len = pages.where(length != "").groupBy("doc_id").agg((F.sum(F.length(length)) + 2 * (F.count(F.lit(1)) - 1)).alias("raw_len"))
    # slides without sections of their own are judged without the ones made from their pages
    titled = sections.join(docs.where(F.col("doc_subtype") != "slides_pdf").select("doc_id"), "doc_id", "left_semi").select("doc_id", "title")
    judged = quality.text_quality(docs.select("doc_id").join(raw_len, "doc_id", "left").fillna(0, ["raw_len"]), pages, titled)
    asked = quality.recommend_from_quality(scored).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("page")).alias("ocr_recommended_pages"), F.sort_array(F.collect_set("reason")).alias("ocr_recommendation_reasons")
    )
    none = F.array()
    return judged.drop("ocr_needed").join(asked, "doc_id", "left").select(
        "doc_id",
        "text_quality",
        "page_text_coverage",
        "section_quality",
        (F.col("ocr_recommended_pages").isNotNull() | (F.col("text_quality") == "image_based")).alias("ocr_needed"),
        F.coalesce("ocr_recommended_pages", none.cast("array<int>")).alias("ocr_recommended_pages"),
        F.coalesce("ocr_recommendation_reasons", none.cast("array<string>")).alias("ocr_recommendation_reasons"),
    )


def apply(
    store: Store,
    chunker: Callable[[DataFrame, DataFrame], DataFrame] = default_chunks,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Bring what is derived from every stored document up to date with its fragments.

    (doc_id, status, source, num_pages_updated, num_chunks): ``missing`` without fragments or
    pages, ``skipped`` without usable fragments, ``unchanged`` where the merged pages are those of
    the last run, else ``applied``. Needs documents (doc_id, doc_subtype), doc_pages and
    fragments (ocr_pages, vision_pages) in the store.
    """
    state = written(standing(store), "enhancement-standing")
    stale = state.where("status = 'stale'").select("doc_id", "input_key")
    if stale.isEmpty():
        return _response(state, None)
    with passing(store.spark):
        return _response(state, _applied(store, stale, chunker, embed))


def _applied(store: Store, stale: DataFrame, chunker, embed) -> DataFrame | None:
    """Merge the pages of ``stale`` documents and rebuild those that have changed by it: how many chunks and sections these have."""
    pages = store.read("doc_pages").join(stale.select("doc_id"), "doc_id", "left_semi")
    fragments = _fragments(store).join(stale.select("doc_id"), "doc_id", "left_semi")
    with passing(store.spark):
        # two writes, so that shuffle files of the one go before those of the other
        merged = alone(store.spark, lambda: enhance.with_best(pages, written(enhance.best_texts(pages, fragments), "enhancement-best")), "enhancement-merged")
        keys = row_set_key(merged, ["page_num", "text", "content_source"], "content_key").join(stale, "doc_id")
        if store.exists("derivations"):
            keys = keys.join(store.read("derivations").select("doc_id", F.col("content_key").alias("_old")), "doc_id", "left")
        else:
            keys = keys.withColumn("_old", F.lit(None).cast("string"))
        keys = written(keys, "enhancement-keys", lasting=True)
        changed = keys.where("not _old <=> content_key").select("doc_id")
        anything = not changed.isEmpty()
        if anything:
            merged = merged.join(changed, "doc_id", "left_semi")
            merged = store.stored(store.replace("enhanced_pages", merged), merged)
    counts = _rebuild(store, merged, changed, chunker, embed) if anything else None
    store.replace("derivations", keys.select("doc_id", "input_key", "content_key"))
    return counts


def _rebuild(store: Store, pages: DataFrame, changed: DataFrame, chunker, embed) -> DataFrame:
    docs = store.read("documents").join(changed, "doc_id", "left_semi").select("doc_id", "doc_subtype")
    docs = written(docs, "enhancement-documents")
    chunks = store.replaced("chunks", lambda: chunker(docs, pages))
    sections = store.replaced("doc_sections", lambda: sections_of(docs, pages))
    scored = store.replaced("page_quality", lambda: quality.page_quality(quality.measured_whole(pages.join(docs, "doc_id"))))
    if embed is not None:
        store.index_vectors(chunks, embed)
    counts = written(
        docs.select("doc_id")
        .join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_chunks")), "doc_id", "left")
        .join(sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_sections")), "doc_id", "left")
        .fillna(0, ["num_chunks", "num_sections"]),
        "enhancement-counts",
        lasting=True,
    )
    # chunks and sections of a document that has none any more
    for artifact, count in (("chunks", "num_chunks"), ("doc_sections", "num_sections")):
        store.delete(counts.where(F.col(count) == 0), [artifact])
    summary = summary_of(docs, pages, sections, scored).join(counts, "doc_id")
    index = F.lit("keyword_only" if embed is None else "vector")
    store.update("documents", summary.withColumn("index_status", index))
    return counts


def _response(state: DataFrame, counts: DataFrame | None) -> DataFrame:
    if counts is None:
        status = F.when(F.col("status").isin("stale", "current"), "unchanged").otherwise(F.col("status"))
        return state.select("doc_id", status.alias("status"), "source", "num_pages_updated", F.when(status != "missing", F.col("num_chunks")).otherwise(F.lit(0)).cast("long").alias("num_chunks"))
    joined = state.join(counts.select("doc_id", F.col("num_chunks").alias("_new")), "doc_id", "left")
    status = F.when(F.col("_new").isNotNull(), "applied").when(F.col("status").isin("stale", "current"), "unchanged").otherwise(F.col("status"))
    n = F.when(status == "missing", 0).otherwise(F.coalesce("_new", "num_chunks"))
    return joined.select("doc_id", status.alias("status"), "source", "num_pages_updated", n.cast("long").alias("num_chunks"))
