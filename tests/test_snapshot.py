"""Memory as of a time equals memory of the events up to that time."""

from pyspark.sql import functions as F

from lectern.operators import memory, snapshot


def test_like_memory_of_the_events_so_far(spark):
    rows = [
        (i, "chat_question" if i % 3 else "section_read", f"d{i % 2}", f"s{i % 5}", '{"title": "%s layer", "message": "what is %s?"}' % (("attention", "softmax", "kernel")[i % 3], ("gradient", "tensor")[i % 2]), i // 4)
        for i in range(60)
    ]
    events = spark.createDataFrame(rows, "id long, event_type string, doc_id string, section_id string, payload string, sec long")
    events = events.withColumn("ts", F.timestamp_seconds("sec")).drop("sec").cache()
    asked = [(f"{d}@{t}", d, t) for d in ("d0", "d1", "d2") for t in (-1, 0, 6, 6, 100)]
    asked = [(f"{r}#{n}", d, t) for n, (r, d, t) in enumerate(asked)]
    requests = spark.createDataFrame(asked, "request_id string, doc_id string, sec long").select("request_id", "doc_id", F.timestamp_seconds("sec").alias("at"))
    got = {r.request_id: r for r in snapshot.snapshots(events, requests).collect()}
    assert len(got) == len(asked)
    placed, who = snapshot.stretches(events, requests)
    states = snapshot.concepts_at(placed, who).collect()
    for name, doc, t in asked:
        past = events.where((F.col("doc_id") == doc) & (F.col("ts") <= F.timestamp_seconds(F.lit(t))))
        ids = sorted((r.id for r in past.select("id").collect()), reverse=True)
        assert got[name].recent_events == ids[:30]
        assert (got[name].current_position == "") == (not ids)
        want = {(r.concept, r.status, r.evidence_count, r.last_section_id) for r in memory.concept_memory(memory.concept_signals(past)).collect()} if ids else set()
        assert {(r.concept, r.status, r.evidence_count, r.last_section_id) for r in states if r.request_id == name} == want
        assert len(got[name].concepts) == len(want)
