"""Learning memory as it stood when it was asked for.

Each request names a document and a time. The times of a document cut its events into stretches; an
event belongs to the stretch that ends with the first request at or after it. What a stretch adds is
aggregated once (counts, last states, the newest few events), and a request sums up the
stretches before it. Events never meet the requests one by one.

Requests of a document are few, so their times are one array; events that no request follows are
left out by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.operators import memory
from lectern.operators.ranking import top_k

#: Events and concepts a snapshot shows.
SHOWN = 30
_MARK = "\u0001"


def stretches(events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``events`` with the number of their ``stretch``, and requests (request_id, doc_id, upto)."""
    times = requests.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("_times"))
    stretch = F.size(F.filter("_times", lambda t: t < F.col("ts")))
    placed = events.join(times, "doc_id").withColumn("stretch", stretch).where(F.col("stretch") < F.size("_times")).drop("_times")
    asked = requests.join(times, "doc_id").select("request_id", "doc_id", (F.array_position("_times", F.col("at")) - 1).alias("upto"))
    return placed, asked


def _seen(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """The parts of all stretches that lie before a request."""
    return parts.join(asked, "doc_id").where(F.col("stretch") <= F.col("upto")).drop("upto")


def _newest(events: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    kept = top_k(events, ["doc_id", "stretch"], [F.col("id").desc()], most, "_n").drop("_n")
    return top_k(_seen(kept, asked), ["request_id"], [F.col("id").desc()], most, "nth")


def concepts_at(placed: DataFrame, asked: DataFrame, most: int = SHOWN) -> DataFrame:
    """(request_id, concept, status, evidence_count, last_section_id, last_seen, nth): the concepts
    seen last, the newest first."""
    marked = placed.withColumn("doc_id", F.concat_ws(_MARK, "doc_id", F.col("stretch").cast("string")))
    parts = memory.concept_counts(memory.concept_signals(marked))
    doc, stretch = F.substring_index("doc_id", _MARK, 1), F.substring_index("doc_id", _MARK, -1).cast("int")
    parts = parts.select("concept", "evidence_count", "last", doc.alias("doc_id"), stretch.alias("stretch"))
    state = _seen(parts, asked).groupBy("request_id", "concept").agg(F.sum("evidence_count").alias("evidence_count"), F.max("last").alias("last"))
    order = [F.col("last.ts").desc(), F.col("last.id").desc(), F.col("concept")]
    return top_k(state, ["request_id"], order, most, "nth").select(
        "request_id", "concept", "last.status", "evidence_count", F.col("last.section_id").alias("last_section_id"), F.col("last.ts").alias("last_seen"), "nth"
    )


def snapshots(events: DataFrame, requests: DataFrame, terms: DataFrame | None = None, most: int = SHOWN) -> DataFrame:
    """One row per request (request_id, doc_id, at): current_position, session_summary,
    active_glossary, concepts and recent_events as of ``at``, events at that time included.

    ``events``: id, ts, event_type, doc_id, section_id, payload; ``terms``: doc_id, id, ts, term,
    translation. A request before all events has empty fields.
    """
    placed, asked = stretches(events, requests)
    recent = _newest(placed.select("doc_id", "stretch", "id"), asked, most).groupBy("request_id").agg(
        F.sort_array(F.collect_list("id"), asc=False).alias("recent_events")
    )
    action = memory.action_summary(F.col("event_type"), memory.payload_field("title"), memory.payload_field("message"))
    summary = memory.session_summary(_newest(placed.where(action != ""), asked, X.ACTIONS_KEPT).drop("nth"), "request_id")
    read = placed.where((F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("section_id", F.lit("")) != ""))
    position = memory.reading_position(_newest(read, asked, 1).drop("nth"), "request_id")
    line = F.concat("concept", F.lit(" ("), "status", F.lit(", evidence="), F.col("evidence_count").cast("string"), F.lit(")"))
    known = concepts_at(placed, asked, most).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))).alias("_lines"))
    out = requests.select("request_id").join(position, "request_id", "left").join(summary, "request_id", "left").join(recent, "request_id", "left")
    out = out.join(known.select("request_id", F.col("_lines.line").alias("concepts")), "request_id", "left")
    strings = F.array().cast("array<string>")
    if terms is not None:
        entries, _ = stretches(terms, requests)
        last = entries.groupBy("doc_id", "stretch", "term").agg(F.max(F.struct("id", "translation")).alias("e"))
        seen = _seen(last, asked).select(F.col("request_id").alias("owner"), "term", "e.id", "e.translation")
        out = out.join(memory.glossary(seen).withColumnRenamed("owner", "request_id"), "request_id", "left")
    else:
        out = out.withColumn("active_glossary", strings)
    return out.select(
        "request_id",
        F.coalesce("current_position", F.lit("")).alias("current_position"),
        F.coalesce("session_summary", F.lit("")).alias("session_summary"),
        F.coalesce("active_glossary", strings).alias("active_glossary"),
        F.coalesce("concepts", strings).alias("concepts"),
        F.coalesce("recent_events", F.array().cast("array<long>")).alias("recent_events"),
    )
