"""Clearing a learner's memory in a store: a session, documents, or everything.

Clearing writes marks or an empty base and reads no more than the ids it marks, however much goes.
``core_memory`` holds one row an owner (doc_id is the owner): current_position (``document:section``),
session_summary, active_glossary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.sources.store import Store

OF_A_SESSION = ("learning_events",)
OF_A_DOCUMENT = ("learning_events", "concept_memory", "reading_records", "session_summaries")
OF_ALL = (*OF_A_DOCUMENT, "term_log", "validation_records", "core_memory")


def session(store: Store) -> None:
    """Events go and owners' summaries become empty; concepts, history and positions stay."""
    store.clear(*OF_A_SESSION)
    if store.exists("core_memory"):
        store.update("core_memory", store.read("core_memory").select("doc_id", F.lit("").alias("session_summary")))


def documents(store: Store, doc_ids: DataFrame) -> None:
    """All that is kept about these documents goes; an owner who reads one of them has no position."""
    store.delete(doc_ids, list(OF_A_DOCUMENT))
    if store.exists("core_memory"):
        owners = store.read("core_memory").select("doc_id", F.split_part("current_position", F.lit(":"), F.lit(1)).alias("_read"), F.contains("current_position", F.lit(":")).alias("_placed"))
        gone = doc_ids.select(F.col("doc_id").alias("_read")).distinct()
        store.update("core_memory", owners.where("_placed").join(gone, "_read", "left_semi").select("doc_id", F.lit("").alias("current_position")))


def everything(store: Store) -> None:
    store.clear(*OF_ALL)
