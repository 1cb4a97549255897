"""What learning memory costs: payloads read once, batches dealt out, long lists of terms walked quickly."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import memory
from lectern.sources.segments import SegmentLog
from lectern.streaming import memory_stream


def events(spark):
    return spark.createDataFrame(
        [(1, "chat_question", "d", "s", '{"message": "graph kernel layer"}')], "id long, event_type string, doc_id string, section_id string, payload string"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def test_a_payload_is_read_once(spark):
    plan = memory.concept_signals(events(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 3


def test_a_batch_of_one_file_is_dealt_out(spark, tmp_path, monkeypatch):
    seen = []
    real = memory_stream.partial_states
    monkeypatch.setattr(memory_stream, "partial_states", lambda e: seen.append(e.rdd.getNumPartitions()) or real(e))
    memory_stream.fold_batch(SegmentLog(spark, str(tmp_path)), events(spark).coalesce(1), 0)
    assert seen == [spark.sparkContext.defaultParallelism]


def plain(terms):
    """The rule, term by term."""
    p = [t[2] for t in terms]
    for i, (name, kind, _) in enumerate(terms):
        if p[i] < 0.7 or not kind:
            continue
        for j, (other, its, _) in enumerate(terms):
            if j != i and its:
                add = 0.05 if kind == "Hyponym-of" and name is not None and other is not None and name in other else 0.03 if its in ("Used-for", "Part-of") else 0.0
                p[j] = min(1.0, p[j] + add)
    return p


@pytest.mark.parametrize("n", [1, 2, 30, 2500])
def test_propagation(spark, n):
    kinds = ("Hyponym-of", "Used-for", "Part-of", "", None, "Other")
    terms = [(None if i % 97 == 96 else f"t{i % 40}", kinds[i % 6], (0.25, 0.6, 0.72, 1.0)[i % 4]) for i in range(n)]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(terms)], "doc_id long, term_no int, english string, relation_type string, p_known double")
    started = time.time()
    got = memory.propagate(rows).orderBy("term_no").collect()
    assert time.time() - started < 15
    assert [(r.doc_id, r.term_no, r.english, r.relation_type) for r in got] == [(1, i, *t[:2]) for i, t in enumerate(terms)]
    assert [r.p_known for r in got] == pytest.approx(plain(terms), abs=1e-12)
