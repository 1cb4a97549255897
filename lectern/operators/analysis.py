"""Document understanding from sections and chunks, without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.functions import text as T
from lectern.operators import assembly
from lectern.operators.ranking import running_before, top_k
from lectern.operators.stage import written


def ordered_join(rows: DataFrame, keys: list[str], order: str, text: str, sep: str, name: str) -> DataFrame:
    """Texts of a group in order, in one string. For groups of bounded size."""
    return rows.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda x: x["_t"]), sep
        ).alias(name)
    )


def section_heads(chunks: DataFrame, size: int) -> DataFrame:
    """First ``size`` characters of each section's squeezed text.

    A chunk is read only if less than ``size`` characters stand before it, so a section of
    any length adds a bounded number of rows to its group. One that begins right behind them still
    counts: the blank before it is the last character.
    """
    flat = chunks.select("doc_id", "section_id", "pos", F.left(T.squeeze(F.col("text")), F.lit(size)).alias("t"))
    flat = flat.where(F.col("t") != "").withColumn("n", F.length("t") + 1)
    near = running_before(flat, ["doc_id", "section_id"], "pos", "n", "before").where(F.col("before") <= size)
    return ordered_join(near, ["doc_id", "section_id"], "pos", "t", " ", "head").withColumn(
        "head", F.left("head", F.lit(size))
    )


def layers(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """L0 (220 characters) and L1 (900) per section; gist, then title where text is missing."""
    heads = section_heads(chunks, 900)
    j = sections.join(heads, ["doc_id", "section_id"], "left")
    text = F.coalesce(T.blank_to_null(F.col("head")), T.squeeze(F.coalesce("gist", F.lit(""))))
    l0 = F.coalesce(T.blank_to_null(F.left(text, F.lit(220))), F.col("title"))
    return j.select(
        "doc_id", "section_id", "title", l0.alias("l0"),
        F.coalesce(T.blank_to_null(F.left(text, F.lit(900))), l0).alias("l1"),
    )


def opening_text(chunks: DataFrame, most: int = 30) -> DataFrame:
    """The first 30 chunks of each document in one text."""
    first = top_k(chunks.select("doc_id", "pos", "text"), ["doc_id"], [F.col("pos")], most, "_n")
    return ordered_join(first, ["doc_id"], "pos", "text", "\n", "opening")


def reading_minutes(text: Column) -> Column:
    minutes = F.floor(F.size(T.words(text)) / 180)
    return F.greatest(F.lit(5), F.least(F.lit(120), F.when(minutes == 0, 5).otherwise(minutes))).cast("int")


def key_terms(text: Column) -> Column:
    """Glossary terms found in the text, then capitalised words, twelve at most."""
    known = F.array_compact(
        F.array(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)) for t in X.TERM_TRANSLATIONS])
    )
    named = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9-]{2,})\b"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(known, named)), 1, 12)


def translation(term: Column) -> Column:
    return T.lookup(term, X.TERM_TRANSLATIONS, "")


def outline(docs: DataFrame, sections: DataFrame, most: int = 30) -> DataFrame:
    """Outline graph text of the first 30 sections.

    A section hangs under the last earlier section of a smaller level if that is exactly
    one level up, else under the document. ``sections``: doc_id, section_no (from 1), title,
    section_id, level.
    """
    kept = top_k(sections, ["doc_id"], [F.col("section_no")], most, "no")
    shown = F.translate(F.coalesce(T.blank_to_null(F.col("title")), F.col("section_id")), '"[]', "'()")
    level = F.greatest(F.lit(1), F.coalesce(F.col("level"), F.lit(1)))
    lists = kept.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("no", level.alias("level"), shown.alias("title")))).alias("s")
    )

    def lines(x: Column, i: Column) -> Column:
        above = F.filter(F.slice(F.col("s"), 1, i), lambda y: y["level"] < x["level"])
        last = F.try_element_at(above, F.lit(-1))
        node = F.concat(F.lit("s"), x["no"].cast("string"))
        parent = F.when(last["level"] == x["level"] - 1, F.concat(F.lit("s"), last["no"].cast("string"))).otherwise("doc")
        return F.concat(
            F.lit("  "), node, F.lit('["'), x["title"], F.lit('"]\n  '), F.coalesce(parent, F.lit("doc")), F.lit(" --> "), node
        )

    body = F.array_join(F.transform("s", lines), "\n")
    empty = F.lit('  empty["Document"]\n  doc --> empty')
    return docs.select("doc_id").join(lists, "doc_id", "left").select(
        "doc_id",
        F.concat(
            F.lit("graph TD\n  doc[\""), F.col("doc_id").cast("string"), F.lit("\"]\n"), F.coalesce(body, empty)
        ).alias("outline"),
    )


def resolve_layer(l0: Column, l1: Column, need_detail: Column) -> Column:
    """struct(content, layer): L0 unless detail is needed, then L1, then L0 with retrieval, else L2."""
    has0, has1 = F.coalesce(l0, F.lit("")) != "", F.coalesce(l1, F.lit("")) != ""
    pick = lambda c, name: F.struct(c.alias("content"), F.lit(name).alias("layer"))
    return (
        F.when(has0 & ~need_detail, pick(l0, "L0")).when(has1, pick(l1, "L1")).when(has0, pick(l0, "L0+L2"))
        .otherwise(pick(F.lit(""), "L2"))
    )


#: What a section's text is taken from, the best first.
SOURCES = ("chunks", "parsed", "slide", "pages", "gist")


def _page_rows(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, section_id, rank, at, text): stripped texts of the slides and page ranges that are sections' texts.

    Page ranges are exploded to page numbers and slides are told by their name, so that pages meet what
    is asked of them once, by an equi-join.
    """
    keys = ["doc_id", "section_id"]
    number = F.regexp_extract("section_id", r"^slide_(\d{1,18})$", 1)
    slide = sections.where(number != "").select(*keys, F.lit(3).alias("rank"), number.cast("long").alias("at"))
    slide = slide.where(F.concat(F.lit("slide_"), F.col("at").cast("string")) == F.col("section_id")).distinct()
    spans = sections.where(F.col("page_start").isNotNull()).select(
        *keys, F.lit(4).alias("rank"),
        F.explode(F.sequence("page_start", F.greatest("page_start", F.coalesce("page_end", "page_start"))).cast("array<long>")).alias("at"),
    )
    texts = pages.select("doc_id", F.col("page_num").cast("long").alias("at"), T.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    return slide.unionByName(spans).join(texts, ["doc_id", "at"]).select(*keys, "rank", "at", "text")


def _chunk_rows(chunk_texts: DataFrame) -> DataFrame:
    """As ``_page_rows``, of the chunks."""
    return chunk_texts.select("doc_id", "section_id", F.lit(1).alias("rank"), F.col("pos").cast("long").alias("at"), T.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")


def section_text(sections: DataFrame, chunk_texts: DataFrame, parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of a section: its chunks, else the parsed text, else its slide, else its pages, else the gist.

    ``chunk_texts``: doc_id, section_id, pos, text. ``parsed``: doc_id, section_id, section_no, text.
    ``pages``: doc_id, page_num, text. What a section may take its text from meets in one grouping with the section.
    """
    keys = ["doc_id", "section_id"]
    own = sections.select(*keys, F.lit(5).alias("rank"), F.lit(0).cast("long").alias("at"), F.coalesce("gist", F.lit("")).alias("text"))
    told = parsed.select(*keys, F.lit(2).alias("rank"), F.col("section_no").cast("long").alias("at"), T.strip(F.coalesce("text", F.lit(""))).alias("text"))
    rows = _chunk_rows(chunk_texts).unionByName(told).unionByName(_page_rows(sections, pages)).unionByName(own)
    # grouped where they meet: before that a section has one row or two in a task, and putting those into lists only costs
    met = rows.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "at", "text"))).alias("_rows"))
    of = lambda rank: F.filter("_rows", lambda r: r["rank"] == rank)["text"]
    joined = lambda rank: T.blank_to_null(T.strip(F.array_join(of(rank), "\n\n")))
    texts = [joined(1), T.blank_to_null(F.get(of(2), F.lit(0))), joined(3), joined(4)]
    found = F.coalesce(*[F.when(t.isNotNull(), F.struct(t.alias("text"), F.lit(name).alias("source"))) for t, name in zip(texts, SOURCES)])
    # one row for each row of sections: rows of a section that is not there have no gist, and none come out
    each = met.withColumn("_found", found).select(*keys, "_found", F.explode(of(5)).alias("_gist"))
    return each.select(*keys, F.coalesce("_found.text", "_gist").alias("text"), F.coalesce("_found.source", F.lit("gist")).alias("text_source"))


def section_text_pieces(sections: DataFrame, chunk_texts: DataFrame, parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """``section_text`` for sections of any length: (doc_id, section_id, text_source, piece_no, piece).

    What a section has is decided on keys and lengths; only the texts of its best source are placed and
    cut. A section without any text has no piece.
    """
    keys = ["doc_id", "section_id"]
    ranked = [*keys, "rank"]
    first = parsed.groupBy(*keys).agg(F.min_by("text", "section_no").alias("text"), F.min("section_no").cast("long").alias("at"))
    told = first.select(*keys, F.lit(2).alias("rank"), "at", T.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    own = sections.select(*keys, F.lit(5).alias("rank"), F.lit(0).cast("long").alias("at"), F.col("gist").alias("text")).where("text <> ''")
    found = _chunk_rows(chunk_texts).unionByName(told).unionByName(_page_rows(sections, pages)).unionByName(own)
    found = written(found, "section-texts")
    best = assembly.sizes(found, ranked, "at", "\n\n").groupBy(*keys).agg(F.min(F.struct("rank", "last", "chars")).alias("b"))
    best = written(best.select(*keys, "b.*").join(sections.select(*keys), keys, "left_semi"), "section-sources")
    cut = assembly.pieces(found, ranked, "at", "\n\n", sized=best)
    return cut.select(*keys, F.element_at(F.array(*map(F.lit, SOURCES)), F.col("rank")).alias("text_source"), "piece_no", "piece")


def full_text_pieces(chunks: DataFrame) -> DataFrame:
    """``full_text`` for documents of any length: (doc_id, piece_no, piece)."""
    shown = assembly.stripped_rows(chunks.select("doc_id", "pos", "text").where("text <> ''"), ["doc_id"], "pos")
    return assembly.pieces(shown, ["doc_id"], "pos", "\n\n")


def full_text(chunks: DataFrame) -> DataFrame:
    """All chunk texts of a document, blank-line separated, where that is wanted in one row."""
    return ordered_join(chunks.where(F.col("text") != ""), ["doc_id"], "pos", "text", "\n\n", "full_text").withColumn(
        "full_text", T.strip(F.col("full_text"))
    )


def glossary(logged: DataFrame, understood: DataFrame) -> DataFrame:
    """Logged terms, then understood terms that were not logged."""
    fresh = understood.join(logged.select("english").distinct(), "english", "left_anti")
    return logged.select("english", "chinese", F.lit("log").alias("origin")).unionByName(
        fresh.select("english", "chinese", F.lit("analysis").alias("origin"))
    )
