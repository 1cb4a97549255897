"""Study briefs of stored documents: served from the store, generated through a model slot on demand.

A request that does not force gets the stored brief, or the notice that there is none. A forced one
asks the slot about its document; an answer that holds a whole brief is stored and served, any other
outcome is served as unavailable with its reason and leaves the stored brief as it was. All requests
of a call see the store as it was before; a document that several of them force is asked once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import answers as A
from lectern.functions import text as T
from lectern.operators import prefixes
from lectern.operators.ranking import top_k
from lectern.operators.stage import written
from lectern.sources.store import Store

# ---- fixed values: what a prompt and a brief hold ----
SECTIONS_SHOWN, CHUNKS_SHOWN = 12, 8
GIST_CHARS, CHUNK_CHARS, QUOTE_CHARS, REASON_CHARS = 120, 420, 260, 300
FAILED = "LLM brief failed; enhanced brief required: "
NOT_CONFIGURED = "LLM brief is not configured; enhanced brief is required."
LECTURE_TYPES = ("slides_pdf", "lecture_slide", "courseware")

#: What is asked for, in our own words; field names are what ``parsed`` reads.
PAPER_TASK = (
    "Write a study brief of this paper for university students, as one JSON object without fences. Fields: tldr (3 to 5 sentences, list), problem, "
    "motivation, contributions (list of claim, why_it_matters, evidence), method_walkthrough (list of title, explanation, evidence), reading_focus "
    "(list of section_id, section_title, reason), review_questions (list of question, level, expected_answer_hint), limitations (list). "
    "Take evidence from the sections and chunks below."
)
LECTURE_TASK = (
    "Write a learning analysis of this lecture, as one JSON object without fences. Fields: brief_type (\"lecture\"), tldr (3 to 5 sentences, list), problem "
    "(its topic), motivation, core_concepts (list of claim, why_it_matters, evidence), method_walkthrough (a learning path: list of title, explanation, evidence), "
    "reading_focus (slides to go back to: list of section_id, section_title, reason), review_questions (self-check questions: list of question, level, "
    "expected_answer_hint), limitations (list: what is easily confused). Take evidence from the sections and chunks below."
)

_EVIDENCE = "struct<section_id:string,section_title:string,quote:string>"


def is_lecture(subtype: Column) -> Column:
    return F.coalesce(subtype.isin(*LECTURE_TYPES), F.lit(False))


# --- prompts ---------------------------------------------------------------------------------


def prompts(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, prompt) of ``documents`` (doc_id, name, doc_subtype): their first sections
    (section_no, section_id, title, level, gist) and chunks (pos, section_id, text), shortened.

    Rows beyond those shown go before anything is collected; a document without any has a prompt too.
    """
    ids = documents.select("doc_id")
    # texts are cut where they are read: what is ranked and dealt out is as long as what is shown
    gists = sections.select("doc_id", "section_no", "section_id", "title", "level", F.left(F.coalesce("gist", F.lit("")), F.lit(GIST_CHARS)).alias("gist"))
    shown = top_k(gists.join(ids, "doc_id", "left_semi"), ["doc_id"], [F.col("section_no")], SECTIONS_SHOWN, "_n")
    quoted = chunks.select("doc_id", "pos", "section_id", T.quote(F.coalesce("text", F.lit("")), CHUNK_CHARS).alias("text"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(
        F.lit("- "), blank("section_id"), F.lit(": "), blank("title"), F.lit(" (level "), F.coalesce("level", F.lit(1)).cast("string"), F.lit(") "), F.col("gist")
    )
    part = top_k(quoted.join(ids, "doc_id", "left_semi"), ["doc_id"], [F.col("pos")], CHUNKS_SHOWN, "_n")
    piece = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] section "), blank("section_id"), F.lit("\n"), F.col("text"))
    gathered = lambda df, c, sep, name: df.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", c.alias("line")))), lambda x: x["line"]), sep).alias(name)
    )
    told = documents.select("doc_id", "name", "doc_subtype").join(gathered(shown, line, "\n", "_sections"), "doc_id", "left").join(gathered(part, piece, "\n\n", "_chunks"), "doc_id", "left")
    text = F.concat(
        F.when(is_lecture(F.col("doc_subtype")), LECTURE_TASK).otherwise(PAPER_TASK), F.lit("\n\nTitle: "), blank("name"),
        F.lit("\n\nSections:\n"), blank("_sections"), F.lit("\n\nChunks:\n"), blank("_chunks"),
    )
    return told.select("doc_id", text.alias("prompt"))


# --- answers ---------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), r"^\w*", 0)


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _string(v: Column, name: str, default: str | None) -> tuple[Column, Column]:
    """A text field and whether it is wrong: of another kind, or missing without a default."""
    kind = _kind(_field(v, name, "variant"))
    missing = kind == ""
    wrong = ~(kind == "STRING") & (~missing if default is not None else F.lit(True))
    return F.when(kind == "STRING", _field(v, name, "string")).otherwise(default), wrong


def _items(v: Column, name: str) -> Column:
    return F.coalesce(_field(v, name, "array<variant>"), F.array().cast("array<variant>"))


def _objects(v: Column, name: str) -> Column:
    return F.filter(_items(v, name), lambda i: _kind(i) == "OBJECT")


def _evidence(item: Column) -> tuple[Column, Column]:
    """Evidence of an item: an object with texts, or a text as its quote; anything else is none."""
    e = _field(item, "evidence", "variant")
    fields = {n: _string(e, n, "") for n in ("section_id", "section_title", "quote")}
    said = T.strip(_field(item, "evidence", "string"))
    quoted = F.struct(F.lit("").alias("section_id"), F.lit("").alias("section_title"), F.left(said, F.lit(QUOTE_CHARS)).alias("quote"))
    whole = F.struct(*[c.alias(n) for n, (c, _) in fields.items()])
    wrong = (_kind(e) == "OBJECT") & reduce(Column.__or__, [w for _, w in fields.values()])
    return F.when(_kind(e) == "OBJECT", whole).when((_kind(e) == "STRING") & (said != ""), quoted).cast(_EVIDENCE), wrong


def _list_of(items: Column, fields: dict[str, str | None], evidence: bool) -> Column:
    """Items as structs, each with ``_wrong``."""

    def one(i: Column) -> Column:
        read = {n: _string(i, n, default) for n, default in fields.items()}
        wrongs = [w for _, w in read.values()] + [_kind(i) != "OBJECT"]
        columns = [c.alias(n) for n, (c, _) in read.items()]
        if evidence:
            found, bad = _evidence(i)
            columns.append(found.alias("evidence"))
            wrongs.append(bad)
        return F.struct(*columns, reduce(Column.__or__, wrongs).alias("_wrong"))

    return F.transform(items, one)


def _settled(items: Column, fields: dict[str, str | None], evidence: bool) -> Column:
    names = [*fields, *(["evidence"] if evidence else [])]
    return F.transform(items, lambda i: F.struct(*[i[n].alias(n) for n in names]))


CLAIM = {"claim": None, "why_it_matters": ""}
STEP = {"title": None, "explanation": None}
FOCUS = {"section_id": None, "section_title": None, "reason": None}
QUESTION = {"question": None, "level": "basic", "expected_answer_hint": ""}


def parsed(answers: DataFrame) -> DataFrame:
    """``answers`` (..., answer) with ``brief``, a struct, or null and the reason in ``error``.

    The JSON object may be fenced or stand in prose. Lists of claims and steps pass over what is no
    object and are empty if they are no list; a lecture's core concepts stand in for missing claims.
    A text as evidence becomes its quote, other evidence is left out. A field of the wrong kind, or a
    missing one that has no default, makes the answer no brief. A null or empty answer is none.
    """
    found = answers.withColumn("_v", F.try_parse_json(A.json_text(F.coalesce("answer", F.lit("")))))
    v = F.col("_v")
    texts = {n: _string(v, n, d) for n, d in (("brief_type", "paper"), ("problem", ""), ("motivation", ""))}
    claims_missing = _kind(_field(v, "contributions", "variant")).isin("", "VOID") & (texts["brief_type"][0] == "lecture")
    claims = F.when(claims_missing, _objects(v, "core_concepts")).otherwise(_objects(v, "contributions"))
    lists = {
        "contributions": (claims, CLAIM, True),
        "method_walkthrough": (_objects(v, "method_walkthrough"), STEP, True),
        "reading_focus": (_items(v, "reading_focus"), FOCUS, False),
        "review_questions": (_items(v, "review_questions"), QUESTION, False),
    }
    wrong = {n: w for n, (_, w) in texts.items()}
    read = found
    for name, (items, fields, evidence) in lists.items():  # each list is read once
        read = read.withColumn(f"_{name}", _list_of(items, fields, evidence))
        wrong[name] = F.exists(f"_{name}", lambda i: i["_wrong"])
    for name in ("reading_focus", "review_questions", "tldr", "limitations"):
        kind = _kind(_field(v, name, "variant"))
        wrong[name] = wrong.get(name, F.exists(_items(v, name), lambda i: _kind(i) != "STRING")) | ~kind.isin("", "ARRAY")
    bad = F.array_compact(F.array(*[F.when(w, n) for n, w in wrong.items()]))
    said = lambda n: F.transform(_items(v, n), lambda i: F.try_variant_get(i, "$", "string"))
    brief = F.struct(
        *[c.alias(n) for n, (c, _) in texts.items()], said("tldr").alias("tldr"),
        *[_settled(F.col(f"_{n}"), f, e).alias(n) for n, (_, f, e) in lists.items()], said("limitations").alias("limitations"),
    )
    error = F.when(v.isNull(), "no JSON object in the answer").when(F.size(bad) > 0, F.concat(F.lit("not as asked: "), F.array_join(bad, ", "))).otherwise("")
    return read.withColumn("_error", error).withColumn("brief", F.when(F.col("_error") == "", brief)).withColumn("error", F.col("_error")).drop(
        "_v", "_error", *[f"_{n}" for n in lists]
    )


# --- serving ---------------------------------------------------------------------------------


def generated(store: Store, documents: DataFrame, slot: prefixes.Slot) -> DataFrame:
    """(doc_id, brief, error) of ``documents``, one of both each; sections and chunks come from the store."""
    spark = store.spark
    sections = store.read("doc_sections") if store.exists("doc_sections") else spark.createDataFrame([], "doc_id string, section_no long, section_id string, title string, level int, gist string")
    chunks = store.read("chunks") if store.exists("chunks") else spark.createDataFrame([], "doc_id string, pos long, section_id string, text string")
    asked = prompts(documents, sections, chunks).withColumn("key", F.col("doc_id"))
    got = written(prefixes.asked(asked, slot), "brief-answers").withColumnRenamed("error", "_failed")
    told = parsed(got).withColumn("error", F.coalesce("_failed", "error"))
    lectures = documents.select("doc_id", is_lecture(F.col("doc_subtype")).alias("_lecture"))
    kind = F.when(F.col("_lecture"), "lecture").otherwise(F.col("brief.brief_type"))
    return told.join(lectures, "doc_id").select("doc_id", F.when(F.col("brief").isNotNull(), F.col("brief").withField("brief_type", kind)).alias("brief"), "error")


def serve(store: Store, requests: DataFrame, slot: prefixes.Slot | None = None) -> DataFrame:
    """(request_id, doc_id, title, source, brief_type, text_quality, ocr_needed, brief, error) for
    ``requests`` (request_id, doc_id, force, ts). New briefs and the events are added to the store.

    ``source`` is cached, not_generated, llm or unavailable; null where the store has no such
    document. A null ``force`` does not force.
    """
    asked = requests.select("request_id", "doc_id", F.coalesce("force", F.lit(False)).alias("force"), "ts")
    known = store.read("documents").select("doc_id", F.col("name").alias("title"), "doc_subtype", "text_quality", "ocr_needed", F.lit(True).alias("_known"))
    rows = written(asked.join(known, "doc_id", "left"), "brief-requests")
    none = "doc_id string, _brief {kind}, _reason string"
    forced = rows.where("force and _known").groupBy("doc_id").agg(F.first("title").alias("name"), F.first("doc_subtype").alias("doc_subtype"))
    cached = store.read("briefs").select("doc_id", F.col("brief").alias("_cached")) if store.exists("briefs") else None
    new = None
    if slot is not None:
        new = written(generated(store, forced, slot), "briefs-new").select("doc_id", F.col("brief").alias("_brief"), F.concat(F.lit(FAILED), "error").alias("_reason"))
    kind = (new.schema["_brief"] if new is not None else cached.schema["_cached"] if cached is not None else parsed(requests.sparkSession.createDataFrame([], "answer string")).schema["brief"]).dataType
    if new is None:
        new = forced.select("doc_id", F.lit(None).cast(kind).alias("_brief"), F.lit(NOT_CONFIGURED).alias("_reason"))
    if cached is None:
        cached = store.spark.createDataFrame([], none.format(kind=kind.simpleString())).select("doc_id", F.col("_brief").alias("_cached"))
    joined = rows.join(new, "doc_id", "left").join(cached, "doc_id", "left")
    has_new, has_cached = F.col("_brief").isNotNull(), F.col("_cached").isNotNull()
    source = F.when(F.col("_known").isNull(), None).when(F.col("force"), F.when(has_new, "llm").otherwise("unavailable")).otherwise(F.when(has_cached, "cached").otherwise("not_generated"))
    brief = F.when(F.col("_known") & F.col("force"), F.col("_brief")).when(F.col("_known"), F.col("_cached"))
    served = joined.select(
        "request_id", "doc_id", "title", source.alias("source"),
        F.when(F.col("_known"), F.coalesce(brief["brief_type"], F.when(is_lecture(F.col("doc_subtype")), "lecture").otherwise("paper"))).alias("brief_type"),
        "text_quality", "ocr_needed", brief.alias("brief"),
        F.when(F.col("_known").isNull(), "Document not found").when(source == "unavailable", F.col("_reason")).otherwise("").alias("error"), "ts",
    )
    served = written(served, "briefs-served")
    made = new.where("_brief is not null").select("doc_id", F.col("_brief").alias("brief"))
    store.replace("briefs", made)
    told = F.to_json(
        F.when(F.col("source") == "cached", F.struct("source", F.lit(None).cast("string").alias("brief_type"), F.lit(None).cast("string").alias("error"))).otherwise(
            F.struct("source", "brief_type", F.when(F.col("error") != "", F.left("error", F.lit(REASON_CHARS))).alias("error"))
        )
    )
    events = served.where("source in ('cached', 'llm', 'unavailable')").select(
        "doc_id", F.when(F.col("source") == "cached", "brief_view").otherwise("brief_generate").alias("event_type"), F.lit("").alias("section_id"), told.alias("payload"), "ts"
    )
    store.append("learning_events", events)
    return served.drop("ts")
