"""Learning memory derived from an event log.

Events: id, event_type, doc_id, section_id, payload (JSON text), ts. Nothing is updated in
place: states are aggregates over the log, with ids breaking ties of equal times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions import fixed as X
from lectern.functions import text as T
from lectern.operators.ranking import top_k
from lectern.operators.stage import once

NONE = lambda: F.array().cast("array<string>")


def payload_field(name: str) -> Column:
    return F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit(""))


def concepts(event_type: Column, text: Column) -> Column:
    """Concept phrases of an event's text, at most eight.

    Known phrases come first. Stop words and words of one or two letters end a word
    group; a group gives its runs of three words (or all of a shorter group), a single
    word only with four letters or a hyphen.
    """
    usable = event_type.isin(*X.CONCEPT_EVENTS) & (T.strip(text) != "")
    return F.when(usable, T.let(F.lower(text), _phrases)).otherwise(NONE())


def _phrases(low: Column) -> Column:
    known = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in X.CONCEPT_PHRASES]))
    words = F.regexp_extract_all(low, F.lit("([A-Za-z][A-Za-z0-9-]*)"), F.lit(1))
    marked = F.transform(
        words, lambda w: F.when(w.isin(*X.CONCEPT_STOPWORDS) | (F.length(w) <= 2), F.lit("|")).otherwise(w)
    )
    groups = F.filter(
        F.transform(
            F.split(F.array_join(marked, " "), "\\|"), lambda g: F.filter(F.split(F.trim(g), " "), lambda w: w != "")
        ),
        lambda g: F.size(g) > 0,
    )

    def runs(g: Column) -> Column:
        width = F.least(F.lit(3), F.size(g))
        made = F.transform(
            F.sequence(F.lit(1), F.size(g) - width + 1), lambda i: F.array_join(F.slice(g, i, width), " ")
        )
        return F.filter(made, lambda p: (width > 1) | F.contains(p, F.lit("-")) | (F.length(p) >= 4))

    return F.slice(F.array_distinct(F.concat(known, F.flatten(F.transform(groups, runs)))), 1, 8)


def concept_text() -> Column:
    return F.concat_ws(" ", payload_field("message"), payload_field("text_preview"), payload_field("title"))


def payload_values(payload: Column) -> Column:
    """All values of the payload in one lower-case text."""
    values = F.map_values(F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>")))
    return F.lower(F.array_join(values, " "))


def concept_status(event_type: Column, values: Column) -> Column:
    return (
        F.when(event_type.isin("explain_text", "translate_text"), "learning")
        .when(values.rlike(X.NEEDS_REVIEW), "needs_review")
        .when(event_type == "section_read", "seen")
        .otherwise("learning")
    )


def action_summary(event_type: Column, title: Column, message: Column) -> Column:
    return (
        F.when(
            event_type == "section_read",
            F.concat(F.lit("Read "), F.left(F.coalesce(T.blank_to_null(T.strip(title)), F.lit("section")), F.lit(80))),
        )
        .when(
            event_type == "chat_question",
            F.when(T.strip(message) != "", F.concat(F.lit("Asked: "), F.left(T.strip(message), F.lit(120)))).otherwise(
                "Asked a question"
            ),
        )
        .when(event_type == "translate_text", "Translated selected text")
        .when(event_type == "explain_text", "Explained selected text")
        .when(event_type.isin("brief_generate", "brief_view"), "Reviewed study brief")
        .when(event_type == "export_obsidian", "Exported learning notes")
        .otherwise("")
    )


def concept_signals(events: DataFrame) -> DataFrame:
    """One row per event and concept: what an upsert would write."""
    read = once(events, {"_text": concept_text()})
    return read.select(
        "id",
        "ts",
        "event_type",
        "doc_id",
        "section_id",
        concept_status(F.col("event_type"), payload_values(F.col("payload"))).alias("status"),
        F.explode_outer(concepts(F.col("event_type"), F.col("_text"))).alias("concept"),
    ).where(F.col("concept").isNotNull())


def concept_counts(signals: DataFrame) -> DataFrame:
    """Counts and last state per concept and document; combines map-side."""
    return signals.groupBy("concept", "doc_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.max(F.struct("id", "status", "section_id", "ts")).alias("last"),
    )


def last_signals(signals: DataFrame, most: int = X.SIGNALS_KEPT) -> DataFrame:
    """The last signals of a concept, oldest first; only those rows are collected."""
    kept = top_k(signals.select("concept", "doc_id", "id", "event_type"), ["concept", "doc_id"], [F.col("id").desc()], most, "_n")
    return kept.groupBy("concept", "doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("id", "event_type"))), lambda s: s["event_type"]
        ).alias("source_events")
    )


def concept_memory(signals: DataFrame) -> DataFrame:
    return (
        concept_counts(signals)
        .join(last_signals(signals), ["concept", "doc_id"])
        .select(
            "concept",
            "doc_id",
            F.col("last.status").alias("status"),
            "evidence_count",
            "source_events",
            F.col("last.section_id").alias("last_section_id"),
            F.col("last.ts").alias("last_seen"),
            F.col("last.id").alias("last_id"),
        )
    )


def latest_events(events: DataFrame, limit: int = 50, doc_id=None) -> DataFrame:
    """Newest events, payload decoded to JSON text or ``{}`` when broken."""
    own = events if doc_id is None else events.where(F.col("doc_id") == doc_id)
    return own.orderBy(F.col("id").desc()).limit(limit).withColumn(
        "payload", F.coalesce(F.to_json(F.try_parse_json("payload")), F.lit("{}"))
    )


def latest_per_document(events: DataFrame, limit: int) -> DataFrame:
    return top_k(events, ["doc_id"], [F.col("id").desc()], limit, "nth")


def term_log(rows: DataFrame) -> DataFrame:
    """How often a term was explained: first definition, count, last time."""
    return rows.groupBy("term").agg(
        F.min_by("definition", "id").alias("definition"),
        F.count(F.lit(1)).alias("times_explained"),
        F.max("ts").alias("last_seen"),
    )


def glossary(entries: DataFrame, most: int = X.GLOSSARY_KEPT) -> DataFrame:
    """Last translation per term and key; the ``most`` terms added last, oldest first."""
    last = entries.groupBy("owner", "term").agg(F.max(F.struct("id", "translation")).alias("e"))
    kept = top_k(last, ["owner"], [F.col("e.id").desc()], most, "_n")
    line = F.concat(F.col("term"), F.lit(X.GLOSSARY_SEPARATOR), F.col("e.translation"))
    return kept.groupBy("owner").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("e.id"), line.alias("line")))), lambda x: x["line"]).alias(
            "active_glossary"
        )
    )


def session_summary(events: DataFrame, owner: str) -> DataFrame:
    """The last eight actions of an owner in one line."""
    acted = events.withColumn(
        "action", action_summary(F.col("event_type"), payload_field("title"), payload_field("message"))
    ).where(F.col("action") != "")
    kept = top_k(acted.select(owner, "id", "action"), [owner], [F.col("id").desc()], X.ACTIONS_KEPT, "_n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "action"))), lambda a: a["action"]), " | ")
    return kept.groupBy(owner).agg(F.concat(F.lit("Recent learning actions: "), joined).alias("session_summary"))


def reading_position(events: DataFrame, owner: str) -> DataFrame:
    """Where an owner is reading: document and section of the last event that has both."""
    placed = events.where((F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("section_id", F.lit("")) != ""))
    return placed.groupBy(owner).agg(F.max(F.struct("id", "doc_id", "section_id")).alias("p")).select(
        owner, F.concat_ws(":", F.col("p.doc_id"), F.col("p.section_id")).alias("current_position")
    )


def retrieval_hints(memory: DataFrame, positions: DataFrame) -> DataFrame:
    """Per document: section being read and up to eight weak ones of the last twelve concepts.

    ``positions``: doc_id, current_position (``doc:section``).
    """
    recent = top_k(memory, ["doc_id"], [F.col("last_seen").desc(), F.col("last_id").desc(), F.col("concept")], 12, "_n")
    weak = recent.where(F.col("status").isin("needs_review", "learning")).groupBy("doc_id").agg(
        F.slice(
            F.transform(F.array_sort(F.collect_list(F.struct("_n", "concept"))), lambda c: c["concept"]), 1, 8
        ).alias("concepts")
    )
    here = F.when(
        F.split_part("current_position", F.lit(":"), F.lit(1)) == F.col("doc_id"),
        F.regexp_replace("current_position", "^[^:]*:", ""),
    )
    docs = memory.select("doc_id").distinct()
    return docs.join(weak, "doc_id", "left").join(positions, "doc_id", "left").select(
        "doc_id",
        F.coalesce(here, F.lit("")).alias("current_section_id"),
        F.coalesce("concepts", NONE()).alias("concepts"),
    )


def core_context(profile: Column, position: Column, glossary_: Column, summary: Column) -> Column:
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws(
        "\n",
        part("Student Profile: ", profile),
        part("Current Position: ", position),
        part("Active Glossary: ", F.array_join(glossary_, ", ")),
        part("Session Summary: ", summary),
    )


def learning_line(memory: DataFrame, most: int = 8) -> DataFrame:
    """``Learning Concepts: name (status, evidence=n); ...`` per document."""
    recent = top_k(memory, ["doc_id"], [F.col("last_seen").desc(), F.col("last_id").desc(), F.col("concept")], most, "_n")
    item = F.concat("concept", F.lit(" ("), "status", F.lit(", evidence="), F.col("evidence_count").cast("string"), F.lit(")"))
    return recent.groupBy("doc_id").agg(
        F.concat(
            F.lit("Learning Concepts: "),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("i")))), lambda x: x["i"]), "; "),
        ).alias("learning_line")
    )


def cleared(df: DataFrame, doc_id=None) -> DataFrame:
    """What is left after clearing one document's rows, or everything."""
    return df.where(F.lit(False)) if doc_id is None else df.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


# ---------------------------------------------------------------- knowledge tracing


def knowledge(terms: DataFrame, turns: DataFrame) -> DataFrame:
    """p_known per document and term after all turns.

    A mention in a question adds 0.1, in an answer 0.05, at most 1 in all. The cap
    commutes with adding, so turn order does not matter and counts are enough.
    ``terms``: doc_id, term_no, english, relation_type, p_known. ``turns``: doc_id, question, answer.
    """
    said = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower("english"))
    heard = turns.join(terms.select("doc_id", "term_no", "english"), "doc_id").groupBy("doc_id", "term_no").agg(
        F.count_if(said("question")).alias("asked"), F.count_if(said("answer")).alias("explained")
    )
    return terms.join(heard, ["doc_id", "term_no"], "left").withColumn(
        "p_known",
        F.least(
            F.lit(1.0),
            F.col("p_known") + F.coalesce("asked", F.lit(0)) * 0.1 + F.coalesce("explained", F.lit(0)) * 0.05,
        ),
    ).drop("asked", "explained")


def _walk(english, kinds, known) -> np.ndarray:
    """p_known of a document's terms after each in turn has passed on what it may.

    A term gives to all others at once; only the parts of a name are looked for one by one.
    """
    kinds = [k or "" for k in kinds]
    p = np.array([1.0 if v is None else v for v in known], dtype=float)
    related = np.array([k in ("Used-for", "Part-of") for k in kinds]) * 0.03
    named = [(j, e) for j, (e, k) in enumerate(zip(english, kinds)) if k and e is not None]
    for i, kind in enumerate(kinds):
        if not kind or not p[i] >= 0.7:
            continue
        gain = related.copy()
        if kind == "Hyponym-of" and english[i] is not None:
            gain[[j for j, e in named if english[i] in e]] = 0.05
        gain[i] = 0.0
        np.minimum(p + gain, 1.0, out=p)
    return p


@F.pandas_udf(ArrayType(DoubleType()))
def _walk_udf(english: pd.Series, kinds: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([_walk(*row) for row in zip(english, kinds, known)], dtype=object)


def propagate(terms: DataFrame) -> DataFrame:
    """Pass knowledge on along relations, term by term in list order.

    Later terms see what earlier ones passed on, so the terms of one document are one list.
    """
    sized = terms.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("term_no", "english", "relation_type", "p_known"))).alias("ts")
    )
    walked = _walk_udf("ts.english", "ts.relation_type", "ts.p_known")
    known = F.transform(
        F.arrays_zip("ts", walked.alias("p")), lambda t: t["ts"].withField("p_known", t["p"])
    )
    return sized.withColumn("ts", known).select("doc_id", F.inline("ts"))


def knowledge_gaps(terms: DataFrame, messages: DataFrame) -> DataFrame:
    """Terms a message mentions that the learner hardly knows (p_known below 0.4)."""
    weak = terms.where(F.col("p_known") < 0.4).select("doc_id", "term_no", "english")
    met = messages.join(weak, "doc_id").where(F.contains(F.lower("message"), F.lower("english")))
    return met.groupBy("request_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("term_no", "english"))), lambda t: t["english"]), ", "
        ).alias("weak_terms")
    )


# ---------------------------------------------------------------- token accounting


def token_usage(calls: DataFrame, budget: int = X.TOKEN_BUDGET) -> DataFrame:
    """Totals per agent and in all (agent null), with the last model used and budget state.

    ``calls``: id, agent, model, input_tokens, output_tokens.
    """
    return (
        calls.rollup("agent")
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
            F.count(F.lit(1)).alias("calls"),
            F.max_by("model", "id").alias("last_model"),
        )
        .withColumn("within_budget", F.col("total_tokens") <= budget)
    )
