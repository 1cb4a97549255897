"""Learning memory kept up to date from an event stream.

The state is keyed by concept and document and kept as a log of segments. A micro-batch is
aggregated to partial states (counts, last state, last signals) and becomes the segment with its
number; the merge of all segments is the state. After ``MOST_BATCHES`` batches they are folded
into one, so that reading merges a bounded number and the state grows with its keys, not with its
events. A batch that runs again after a failure overwrites its own segment if that was not finished,
and is passed over if its number is covered already, also by a folded segment: events count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.functions import fixed as X
from lectern.operators import memory
from lectern.sources.segments import SegmentLog

#: Batches that stand beside the folded state.
MOST_BATCHES = 8
EVENT_SCHEMA = "id long, event_type string, doc_id string, section_id string, payload string, ts timestamp"
PARTIAL_SCHEMA = (
    "concept string, doc_id string, evidence_count long, last struct<id:long,status:string,section_id:string,ts:timestamp>, "
    "signals array<struct<id:long,event_type:string>>, batch long"
)


def partial_states(events: DataFrame) -> DataFrame:
    """Concept states of one batch; at most 20 signals per concept are collected."""
    from lectern.operators.ranking import top_k

    signals = memory.concept_signals(events)
    kept = top_k(
        signals.select("concept", "doc_id", "id", "event_type"), ["concept", "doc_id"], [F.col("id").desc()], X.SIGNALS_KEPT, "_n"
    )
    collected = kept.groupBy("concept", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "event_type"))).alias("signals")
    )
    return memory.concept_counts(signals).join(collected, ["concept", "doc_id"])


def fold_batch(log: SegmentLog, events: DataFrame, batch_id: int, most: int = MOST_BATCHES) -> None:
    """Take one batch into the state. Batches come in order, and one that the state covers already,
    as a partial or folded, is a replay and changes nothing."""
    if batch_id < log.next_version():
        return
    # a batch may be one file, which one task would read: its rows are dealt out before they are parsed
    dealt = events.repartition(log.spark.sparkContext.defaultParallelism)
    partial = partial_states(dealt).withColumn("batch", F.lit(batch_id).cast("long"))
    log.write(partial, "a", batch_id, batch_id)
    if sum(s.kind == "a" for s in log.live()) > most:
        compact(log)


def run(events: DataFrame, folder: str, checkpoint: str, available_now: bool = True, most: int = MOST_BATCHES):
    """Start folding a stream of events into the state under ``folder``."""
    log = SegmentLog(events.sparkSession, folder)
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: fold_batch(log, batch, batch_id, most)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(partials: DataFrame) -> DataFrame:
    """Partial states folded into one row per concept and document.

    A batch adds at most 20 signals to a concept, and only the newest 20 over all batches
    are collected.
    """
    heads = partials.groupBy("concept", "doc_id").agg(
        F.sum("evidence_count").alias("evidence_count"), F.max("last").alias("last")
    )
    w = Window.partitionBy("concept", "doc_id").orderBy(F.col("s.id").desc())
    signals = (
        partials.select("concept", "doc_id", F.explode("signals").alias("s"))
        .withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= X.SIGNALS_KEPT)
        .groupBy("concept", "doc_id")
        .agg(F.array_sort(F.collect_list("s")).alias("signals"))
    )
    return heads.join(signals, ["concept", "doc_id"])


def read_partials(spark: SparkSession, folder: str) -> DataFrame:
    live = SegmentLog(spark, folder).live()
    return spark.read.schema(PARTIAL_SCHEMA).parquet(*[s.path for s in live]) if live else spark.createDataFrame([], PARTIAL_SCHEMA)


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    return merged(read_partials(spark, folder)).select(
        "concept",
        "doc_id",
        F.col("last.status").alias("status"),
        "evidence_count",
        F.transform("signals", lambda s: s["event_type"]).alias("source_events"),
        F.col("last.section_id").alias("last_section_id"),
        F.col("last.ts").alias("last_seen"),
    )


def compact(log: SegmentLog) -> None:
    """Fold the state and the batches since into one segment, in the order of a hash of the key."""
    live = log.live()
    if len(live) < 2:
        return
    newest = live[-1].high
    rows = merged(read_partials(log.spark, log.root)).withColumn("batch", F.lit(newest).cast("long"))
    key = F.xxhash64("concept", "doc_id")
    log.write(rows.repartitionByRange(key).sortWithinPartitions(key), "b", 0, newest)
    log.vacuum()
