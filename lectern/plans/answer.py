"""From retrieved context to what the reader is shown, with models as optional slots.

A slot is a column function (``llm_fn(prompt) -> answer``); with no slot the offline
answers apply, so every step runs without any service.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import answers as A
from lectern.functions import text as T
from lectern.operators.ranking import top_k

Slot = Callable[[Column], Column] | None

# Guidance in our own words; the labels and their choice decide, not the wording.
POLICY_TEXT = {
    "document_grounded": "Ground every claim in the retrieved text and say when it does not support an answer.",
    "learning_explanation": "Say what the document states first; keep general teaching background apart from it.",
    "extension": "Say what the document covers first; mark comparisons and background as not from the document.",
}
INTENT_TEXT = {
    "figure": "Say what the figure or caption shows.",
    "formula": "Give the role of the formula, then its symbols as far as the text supports them.",
    "detail": "Answer directly.",
    "structure": "Go through the excerpts in document order.",
    "method": "Explain the mechanism from the retrieved method text.",
    "concept": "Define the concept and give its key role.",
}
DEPTH_TEXT = {"concise": "Be brief.", "expanded": "A fuller explanation is wanted; keep it grounded."}


def guidance(question: Column, formula_evidence: Column) -> Column:
    return F.concat_ws(
        " ",
        T.lookup(T.evidence_policy(question), POLICY_TEXT, ""),
        T.lookup(T.answer_depth(question), DEPTH_TEXT, ""),
        T.lookup(T.question_intent(question, formula_evidence), INTENT_TEXT, ""),
    )


def personal_guidance(memory_context: Column, level: Column) -> Column:
    """Up to three hints from the learner's memory: beginner, known terms, formulas."""
    low = F.lower(memory_context)
    pairs = F.regexp_extract_all(memory_context, F.lit(r"([^,\n]+?)\|\|\|"), F.lit(1))
    known = F.slice(F.filter(F.transform(pairs, lambda t: F.trim(t)), lambda t: t != ""), 1, 6)
    return F.concat_ws(
        " ",
        F.when((level == "beginner") | F.contains(low, F.lit("beginner")) | F.contains(memory_context, F.lit("基础")),
               "Explain for a beginner."),
        F.when(F.size(known) > 0, F.concat(F.lit("Known terms: "), F.array_join(known, ", "), F.lit("."))),
        F.when(low.rlike("公式|formula|equation|推导|符号"), "Take care with formulas and symbols."),
    )


def chat_prompt(question: Column, context: Column, memory: Column, guide: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), c))
    return F.concat_ws("\n\n", part("Guidance", guide), part("Memory", memory), part("Context", context), part("Question", question))


def gate(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``error``: missing document, or one that is not ready."""
    d = documents.select(F.col("doc_id"), F.col("status").alias("doc_status"), F.lit(True).alias("known"))
    j = requests.join(d, "doc_id", "left")
    return j.withColumn(
        "error",
        F.when(F.coalesce("doc_id", F.lit("")) == "", "")
        .when(F.col("known").isNull(), "Document not found")
        .when(F.col("doc_status") != "ready", F.concat(F.lit("Document status: "), F.col("doc_status")))
        .otherwise(""),
    ).drop("known", "doc_status")


def answer(requests: DataFrame, evidence: DataFrame, contexts: DataFrame, llm_fn: Slot = None, check_fn: Slot = None) -> DataFrame:
    """Answer, validate and revise. ``requests``: request_id, message, intent, deep.

    Without ``llm_fn`` the answer quotes the first evidence.
    """
    first = evidence.where(F.col("citation") == 1).select("request_id", "quote")
    formulas = evidence.groupBy("request_id").agg(F.bool_or("has_formula").alias("formula_evidence"))
    j = requests.join(first, "request_id", "left").join(contexts, "request_id", "left").join(formulas, "request_id", "left")
    guide = guidance(F.col("message"), F.coalesce("formula_evidence", F.lit(False)))
    j = j.withColumn("prompt", chat_prompt(F.col("message"), F.col("context_text"), F.lit(None).cast("string"), guide))
    drafted = j.withColumn("draft", llm_fn(F.col("prompt")) if llm_fn else A.fallback_answer(F.col("quote")))
    if check_fn is None:
        return drafted.withColumn("answer", F.col("draft")).withColumn("validated", F.lit(False))
    asked = A.needs_validation(F.col("deep"), F.col("intent"))
    checked = drafted.withColumn("check", A.validation(F.when(asked, check_fn(F.col("draft")))))
    second = llm_fn(F.concat_ws("\n\n", "prompt", "draft", F.array_join("check.issues", "; "))) if llm_fn else F.col("draft")
    return checked.withColumn(
        "answer", F.when(asked, A.revised_answer(F.col("draft"), F.col("check"), second)).otherwise(F.col("draft"))
    ).withColumn("validated", asked)


def explain(requests: DataFrame, cache: DataFrame, model: str = "", llm_fn: Slot = None) -> DataFrame:
    """Explain or translate selected text: mode gate, translation cache, then the model slot.

    Without a model the first 1000 characters are given back. ``cache``: cache_key, content.
    """
    keyed = requests.withColumn(
        "cache_key",
        F.when(
            (F.col("mode") == "translate") & (F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("section_id", F.lit("")) != ""),
            A.translation_key(F.col("doc_id"), F.col("section_id"), F.col("mode"), F.lit(model), F.col("message")),
        ),
    )
    j = keyed.join(cache.select("cache_key", F.col("content").alias("cached")), "cache_key", "left")
    usable = F.col("mode").isin(*A.EXPLAIN_MODES) & (F.coalesce("message", F.lit("")) != "")
    fresh = llm_fn(F.col("message")) if llm_fn else F.left("message", F.lit(1000))
    cached = T.blank_to_null(F.col("cached"))
    return j.withColumn(
        "content",
        F.when(~usable, "No text selected for explanation/translation.").otherwise(F.coalesce(cached, fresh)),
    ).withColumn("from_cache", usable & cached.isNotNull())


def briefs(documents: DataFrame, cache: DataFrame, generated: DataFrame | None, force: Column) -> DataFrame:
    """Source of each document's brief: cached, not_generated, the model's, or unavailable."""
    j = documents.join(cache.select("doc_id", F.lit(True).alias("has_cache")), "doc_id", "left")
    if generated is None:
        j = j.withColumn("has_new", F.lit(False))
    else:
        j = j.join(generated.select("doc_id", F.lit(True).alias("has_new")), "doc_id", "left")
    source = (
        F.when(~force & F.coalesce("has_cache", F.lit(False)), "cached")
        .when(~force, "not_generated")
        .when(F.coalesce("has_new", F.lit(False)), "llm")
        .otherwise("unavailable")
    )
    return j.select("doc_id", A.brief_type(F.col("doc_subtype")).alias("brief_type"), source.alias("source"))


def reading_log(memory: DataFrame, day: Column) -> DataFrame:
    """Markdown reading log and glossary per document.

    ``memory``: doc_id, current_position, session_summary, active_glossary.
    """
    doc = F.regexp_replace(F.regexp_replace("doc_id", r"[/\\]", "_"), r"\.\.", "_")
    items = F.coalesce("active_glossary", F.array().cast("array<string>"))
    log = F.concat(
        F.lit("---\ndate: "), day, F.lit("\ndoc_id: "), doc, F.lit("\nposition: "), F.coalesce("current_position", F.lit("")),
        F.lit("\n---\n\n# Reading Session — "), doc,
        F.lit("\n\n## Session Summary\n"),
        F.coalesce(T.blank_to_null(F.col("session_summary")), F.lit("First reading session.")),
        F.lit("\n\n## Position\n"), F.coalesce(T.blank_to_null(F.col("current_position")), F.lit("Not set.")),
        F.lit("\n\n## Active Terms\n"), F.array_join(F.transform(items, lambda g: F.concat(F.lit("- "), g, F.lit("\n"))), ""),
    )
    terms = F.array_join(
        F.transform(
            items,
            lambda g: F.concat(
                F.lit("- **"), F.substring_index(g, "|||", 1), F.lit("**（"),
                F.when(F.contains(g, F.lit("|||")), F.substring_index(g, "|||", -1)).otherwise(""), F.lit("）\n"),
            ),
        ),
        "",
    )
    return memory.select(
        "doc_id",
        F.concat(day, F.lit("_"), doc, F.lit(".md")).alias("log_name"),
        log.alias("log_text"),
        F.concat(F.lit("# Glossary — "), doc, F.lit("\n\n"), terms).alias("glossary_text"),
    )


#: Sections of a document that its concept map shows.
MAPPED = 30


def concept_map(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, map_name, map_text): the first sections of each document as a diagram in Markdown.

    A section hangs on the last one above it if that is one level up, else on the document.
    ``sections``: doc_id, section_no, section_id, title, level; a blank title gives way to the id, a
    level that is missing or below one counts as one.
    """
    named = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("section_id") != "", F.col("section_id")))
    shown = top_k(sections, ["doc_id"], [F.col("section_no")], MAPPED, "n")
    item = F.struct("n", F.coalesce(named, F.concat(F.lit("Section "), F.col("n").cast("string"))).alias("name"), F.greatest(F.lit(1), F.coalesce("level", F.lit(1))).alias("level"))
    listed = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_s"))

    def lines(s: Column) -> Column:
        above = F.try_element_at(F.filter("_s", lambda t: (t["n"] < s["n"]) & (t["level"] < s["level"])), F.lit(-1))
        node = lambda t: F.concat(F.lit("s"), t["n"].cast("string"))
        parent = F.when(F.coalesce(above["level"] == s["level"] - 1, F.lit(False)), node(above)).otherwise("doc")
        name = F.translate(F.replace(s["name"], F.lit('"'), F.lit("'")), "[]", "()")
        return F.concat(F.lit("  "), node(s), F.lit('["'), name, F.lit('"]\n  '), parent, F.lit(" --> "), node(s))

    empty = '  empty["No extracted sections"]\n  doc --> empty'
    joined = documents.select("doc_id").distinct().join(listed, "doc_id", "left")
    body = F.coalesce(F.array_join(F.transform("_s", lines), "\n"), F.lit(empty))
    doc = F.regexp_replace(F.regexp_replace("doc_id", r"[/\\]", "_"), r"\.\.", "_")
    return joined.select(
        "doc_id", F.concat(doc, F.lit("_concepts.md")).alias("map_name"),
        F.concat(F.lit("# Concept Map — "), doc, F.lit("\n\n```mermaid\ngraph TD\n  doc[Document]\n"), body, F.lit("\n```\n")).alias("map_text"),
    )
