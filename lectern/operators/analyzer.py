"""The document analyzer around its model: the texts it is asked about, and what it answers.

A document is as many page rows as it has; its text is never put together. Running offsets say where
a page stands in the text, pages are cut into pieces of ``PIECE`` characters, and a window of the text
is joined from the few pieces it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import answers
from lectern.functions import text as T
from lectern.operators.ranking import running_before, top_k

# ---- fixed values: what the analyzer reads and falls back to ----
PAGE_CHARS = 3000
BEFORE_PAGE, AFTER_PAGE = 500, 3500
BEFORE_TITLE, AFTER_TITLE = 200, 3000
SECTIONS_ASKED = 10
STRUCTURE_CHARS = 8000
L0_CHARS, L1_CHARS = 2000, 5000
TERMS_KEPT = 20
DEFAULT_TYPE, DEFAULT_LANGUAGE, DEFAULT_DIFFICULTY, DEFAULT_MINUTES = "research_paper", "en", "intermediate", 30

#: Characters of a piece of text.
PIECE = 4096


def placed(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_num, text) with the offset at which each stands in the text of its
    document: pages in order, one newline between two. Characters are code points."""
    sized = pages.select("doc_id", "page_num", F.coalesce("text", F.lit("")).alias("text"))
    return running_before(sized.withColumn("_n", F.length("text") + 1), ["doc_id"], "page_num", "_n", "offset").withColumnRenamed("_n", "n")


def pieces(pages: DataFrame) -> DataFrame:
    """(doc_id, block, at, piece): the text of ``placed`` pages cut where a block of ``PIECE``
    characters begins. The newline behind a page belongs to it, behind the last one too."""
    first, last = F.floor(F.col("offset") / PIECE), F.floor((F.col("offset") + F.col("n") - 1) / PIECE)

    def cut(block: Column) -> Column:
        start = F.greatest(block * PIECE, F.col("offset"))
        end = F.least((block + 1) * PIECE, F.col("offset") + F.col("n"))
        text = F.substr(F.concat("text", F.lit("\n")), (start - F.col("offset") + 1).cast("int"), (end - start).cast("int"))
        return F.struct(block.alias("block"), start.alias("at"), text.alias("piece"))

    return pages.select("doc_id", F.inline_outer(F.transform(F.sequence(first, last), cut)))


def excerpts(cut: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, keys, excerpt): characters start to end (exclusive) of a document for each row of
    ``windows`` (doc_id, keys, start, end). A window holds few characters, so few pieces meet in it."""
    asked = windows.where("start < end").select("doc_id", *keys, "start", "end", F.explode_outer(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("end") - 1) / PIECE))).alias("block"))
    met = asked.join(cut, ["doc_id", "block"])
    low = F.greatest(F.col("start"), F.col("at"))
    part = F.substr("piece", (low - F.col("at") + 1).cast("int"), (F.col("end") - low).cast("int"))
    parts = met.where("start < at + length(piece) and end > at").groupBy("doc_id", *keys).agg(F.sort_array(F.collect_list(F.struct("at", part.alias("t")))).alias("_parts"))
    joined = parts.select("doc_id", *keys, F.array_join("_parts.t", "").alias("excerpt"))
    return windows.select("doc_id", *keys).join(joined, ["doc_id", *keys], "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))


def section_windows(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section_no, section_id, title, window, l0_text, l1_text) for the first
    ``SECTIONS_ASKED`` sections of each document (doc_id, section_no, section_id, title, page_start).

    Around the place where the section's page stands by a rule of thumb, else around the first
    mention of its title, else the beginning. Titles hold no line break.
    """
    where = placed(pages)
    ends = where.groupBy("doc_id").agg((F.max(F.col("offset") + F.col("n")) - 1).alias("size"))
    asked = top_k(sections, ["doc_id"], [F.col("section_no")], SECTIONS_ASKED, "_n").drop("_n")
    titled = asked.where(F.col("page_start").isNull() & (F.coalesce("title", F.lit("")) != "")).select("doc_id", "section_no", "title")
    at = F.instr(F.col("text"), F.col("title"))
    found = titled.join(where, "doc_id").where(at > 0).groupBy("doc_id", "section_no").agg(F.min(F.col("offset") + at - 1).alias("found"))
    known = asked.join(found, ["doc_id", "section_no"], "left").join(ends, "doc_id")
    page = F.col("page_start").cast("long") * PAGE_CHARS
    no_title = F.col("page_start").isNull() & (F.coalesce("title", F.lit("")) == "")
    mention = F.when(no_title, F.lit(0)).otherwise(F.col("found"))
    start = F.when(F.col("page_start").isNotNull(), page - BEFORE_PAGE).when(mention.isNotNull(), mention - BEFORE_TITLE).otherwise(0)
    end = F.when(F.col("page_start").isNotNull(), page + AFTER_PAGE).when(mention.isNotNull(), mention + AFTER_TITLE).otherwise(AFTER_TITLE)
    windows = known.select(
        "doc_id", "section_no", "section_id", "title", F.greatest(F.lit(0), start).cast("long").alias("start"), F.least("size", end).cast("long").alias("end")
    )
    read = excerpts(pieces(where), windows, ["section_no"])
    return windows.join(read, ["doc_id", "section_no"]).select(
        "doc_id", "section_no", "section_id", "title", F.col("excerpt").alias("window"),
        F.left("excerpt", F.lit(L0_CHARS)).alias("l0_text"), F.left("excerpt", F.lit(L1_CHARS)).alias("l1_text"),
    )


def opening(pages: DataFrame, size: int = STRUCTURE_CHARS) -> DataFrame:
    """(doc_id, excerpt): the first characters of each document, which the structure is read from."""
    where = placed(pages)
    near = where.where(F.col("offset") < size)
    ends = where.groupBy("doc_id").agg(F.least(F.lit(size), F.max(F.col("offset") + F.col("n")) - 1).cast("long").alias("end"))
    return excerpts(pieces(near), ends.select("doc_id", F.lit(0).cast("long").alias("start"), "end"), [])


# --- what the model answers --------------------------------------------------------------------

_SECTION = "section_id:string,id:string,title:string,level:int,page_start:int,page_end:int,section_type:string,difficulty:string"
_TERM = "english:string,chinese:string,relation_type:string"
_ANSWER = (
    "doc_type string, language string, difficulty string, estimated_reading_time int, mermaid_map string, prerequisites array<string>, "
    f"sections array<struct<{_SECTION}>>, key_terms array<struct<{_TERM}>>, l0_summaries map<string,string>, l1_overviews map<string,string>"
)


def parsed_answer(answer: Column) -> Column:
    """A model's answer as a struct with ``error``: fenced JSON, bare JSON or the widest braces; a list
    is no answer. Fields
    that are missing or of another kind take their defaults; sections keep their order and get
    their place as id where they have none."""
    said = F.coalesce(answer, F.lit(""))
    found = F.when(answers.json_list_text(said).isNull(), answers.json_text(said))
    v = F.from_json(found, _ANSWER)
    text = lambda c, default: F.coalesce(c, F.lit(default))
    none = F.create_map().cast("map<string,string>")

    def section(s: Column, i: Column) -> Column:
        return F.struct(
            F.coalesce(s["section_id"], s["id"], i.cast("string")).alias("section_id"), text(s["title"], "").alias("title"),
            F.coalesce(s["level"], F.lit(1)).alias("level"), s["page_start"].alias("page_start"), s["page_end"].alias("page_end"),
            text(s["section_type"], "prose").alias("section_type"), text(s["difficulty"], DEFAULT_DIFFICULTY).alias("difficulty"),
        )

    term = lambda t: F.struct(text(t["english"], "").alias("english"), text(t["chinese"], "").alias("chinese"), t["relation_type"].alias("relation_type"))
    return F.struct(
        F.when(found.isNull() | (F.regexp_replace(F.coalesce(found, F.lit("")), r"\s", "") == "{}"), "no JSON object in the answer").otherwise("").alias("error"),
        text(v["doc_type"], DEFAULT_TYPE).alias("doc_type"),
        text(v["language"], DEFAULT_LANGUAGE).alias("language"),
        text(v["difficulty"], DEFAULT_DIFFICULTY).alias("difficulty"),
        F.coalesce(v["estimated_reading_time"], F.lit(DEFAULT_MINUTES)).alias("estimated_reading_time"),
        text(v["mermaid_map"], "").alias("mermaid_map"),
        F.coalesce(v["prerequisites"], F.array().cast("array<string>")).alias("prerequisites"),
        F.transform(F.filter(v["sections"], lambda s: s.isNotNull()), section).alias("sections"),
        F.transform(F.filter(v["key_terms"], lambda t: t.isNotNull()), term).alias("key_terms"),
        F.coalesce(v["l0_summaries"], none).alias("l0_summaries"),
        F.coalesce(v["l1_overviews"], none).alias("l1_overviews"),
    )


def merged_sections(answered: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, section_no, section_id, title, level, page_start, page_end, section_type, difficulty,
    origin): the model's sections where it gave a list with any, else the parser's.

    ``answered``: doc_id, understanding (``parsed_answer``); ``parsed``: doc_id, section_no,
    section_id, title, level, page_start, page_end. Both stay rows: no list of sections is collected.
    """
    given = answered.where(F.col("understanding.error") == "")
    own = given.select("doc_id", F.posexplode_outer("understanding.sections").alias("section_no", "s")).where("s is not null")
    model = own.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "s.*", F.lit("model").alias("origin"))
    silent = given.where(F.coalesce(F.size("understanding.sections"), F.lit(0)) <= 0).select("doc_id")
    parser = parsed.join(silent, "doc_id", "left_semi").select(
        "doc_id", F.col("section_no").cast("long").alias("section_no"), F.coalesce("section_id", F.col("section_no").cast("string")).alias("section_id"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("level", F.lit(1)).alias("level"), "page_start", "page_end",
        F.lit("prose").alias("section_type"), F.lit(DEFAULT_DIFFICULTY).alias("difficulty"), F.lit("parser").alias("origin"),
    )
    return model.unionByName(parser)


def listed_terms(answer: Column) -> Column:
    """Term pairs of an answer that is a JSON list: of its first ``TERMS_KEPT`` items those with both words."""
    items = F.from_json(answers.json_list_text(F.coalesce(answer, F.lit(""))), f"array<struct<{_TERM}>>")
    both = lambda t: (T.blank_to_null(t["english"]).isNotNull()) & (T.blank_to_null(t["chinese"]).isNotNull())
    return F.coalesce(F.filter(F.slice(items, 1, TERMS_KEPT), both), F.array().cast(f"array<struct<{_TERM}>>"))
