"""Learning memory from a stream: several batches, replays and folding give the state of all events."""

import pathlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import memory
from lectern.sources.segments import SegmentLog
from lectern.streaming import memory_stream

WORDS = ("attention", "softmax", "gradient", "kernel")


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (i, "chat_question" if i % 3 else "section_read", f"d{i % 2}", f"s{i % 5}", '{"title": "%s layer", "message": "what is %s?"}' % (WORDS[i % 4], WORDS[i % 3]))
        for i in range(300)
    ]
    made = spark.createDataFrame(rows, "id long, event_type string, doc_id string, section_id string, payload string")
    return made.withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).cache()


def state(df):
    return sorted((r.concept, r.doc_id, r.status, r.evidence_count, tuple(r.source_events), r.last_section_id, r.last_seen) for r in df.collect())


def whole(events):
    return state(memory.concept_memory(memory.concept_signals(events)))


def stream(spark, folder, most=2):
    raw = spark.readStream.schema(memory_stream.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    memory_stream.run(raw, f"{folder}/state", f"{folder}/progress", most=most).awaitTermination()


def lose_last_commit(folder):
    commits = pathlib.Path(folder, "progress/commits")
    last = max(commits.glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)


def test_files_replay_and_folding(spark, events, tmp_path):
    want = whole(events)
    for part in (events.where("id < 120"), events.where("id >= 120")):
        part.repartition(3).write.mode("append").parquet(f"{tmp_path}/events")
        stream(spark, tmp_path)
    log = SegmentLog(spark, f"{tmp_path}/state")
    assert state(memory_stream.current_state(spark, f"{tmp_path}/state")) == want
    assert log.next_version() == 6
    assert [(s.kind, s.low) for s in log.live()][0] == ("b", 0) and len(log.live()) <= 3
    # the last batch finished but its commit was lost: Spark runs it again
    lose_last_commit(tmp_path)
    stream(spark, tmp_path)
    assert state(memory_stream.current_state(spark, f"{tmp_path}/state")) == want
    # and once more after it was folded
    memory_stream.compact(log)
    assert [(s.kind, s.low, s.high) for s in log.live()] == [("b", 0, 5)]
    lose_last_commit(tmp_path)
    stream(spark, tmp_path)
    assert state(memory_stream.current_state(spark, f"{tmp_path}/state")) == want


def test_a_batch_that_died_half_way_is_written_again(spark, events, tmp_path):
    log = SegmentLog(spark, f"{tmp_path}/state")
    memory_stream.fold_batch(log, events.where("id < 100"), 0)
    memory_stream.fold_batch(log, events.where("id >= 100"), 1)
    pathlib.Path(log.live()[-1].path.removeprefix("file:"), "_SUCCESS").unlink()
    assert len(log.live()) == 1
    memory_stream.fold_batch(log, events.where("id >= 100"), 1)
    memory_stream.fold_batch(log, events.where("id >= 100"), 1)
    assert state(memory_stream.current_state(spark, log.root)) == whole(events)


def test_nothing_yet(spark, tmp_path):
    assert memory_stream.current_state(spark, f"{tmp_path}/none").count() == 0
