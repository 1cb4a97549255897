"""The log-structured store: only changed rows are written, reading merges, compaction keeps the state."""

import pytest

from lectern.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, status string, n int")


def held(store, artifact="documents"):
    return sorted(map(tuple, store.read(artifact).select("doc_id", "status", "n").collect()))


def written_rows(store, segment):
    return store.spark.read.parquet(segment.path).count()


def test_update_writes_changed_rows_only(spark, store):
    store.replace("documents", docs(spark, [(f"d{i}", "parsing", i) for i in range(100)]))
    segment = store.update("documents", spark.createDataFrame([("d1", "ready"), ("d2", "parsing"), ("none", "ready")], "doc_id string, status string"))
    assert written_rows(store, segment) == 1
    assert ("d1", "ready", 1) in held(store) and ("d2", "parsing", 2) in held(store) and len(held(store)) == 100
    again = spark.createDataFrame([("d1", "ready")], "doc_id string, status string")
    assert store.update("documents", again) is None
    assert len(store.log("documents").live()) == 2
    added = store.update("documents", spark.createDataFrame([("d3", 7)], "doc_id string, num_chunks int"))
    assert written_rows(store, added) == 1
    assert store.read("documents", "d3").collect()[0].num_chunks == 7


def test_delete_and_write_again(spark, store):
    store.replace("documents", docs(spark, [("a", "x", 1), ("b", "x", 2), ("b", "x", 3)]))
    store.delete(spark.createDataFrame([("b",), ("zz",)], "doc_id string"), ["documents", "chunks"])
    assert held(store) == [("a", "x", 1)]
    store.replace("documents", docs(spark, [("b", "y", 9)]))
    assert held(store) == [("a", "x", 1), ("b", "y", 9)]


def test_appended_rows_join_what_was_replaced(spark, store):
    store.append("learning_events", docs(spark, [("a", "1", 1)]))
    store.append("learning_events", docs(spark, [("a", "2", 2), ("b", "2", 2)]))
    assert len(held(store, "learning_events")) == 3
    assert "Join" not in store.read("learning_events")._jdf.queryExecution().executedPlan().toString()
    store.replace("learning_events", docs(spark, [("a", "3", 3)]))
    store.append("learning_events", docs(spark, [("a", "4", 4)]))
    assert held(store, "learning_events") == [("a", "3", 3), ("a", "4", 4), ("b", "2", 2)]


def test_compaction_by_size_keeps_the_state(spark, store):
    store.replace("documents", docs(spark, [(f"d{i:04d}", "parsing" * 5, i) for i in range(5000)]))
    base = store.compact("documents")
    assert (base.kind, base.low, base.high) == ("b", 0, 0)
    for i in range(5):
        store.replace("documents", docs(spark, [(f"d{j:04d}", f"s{i}", j) for j in range(i, 10)]))
    store.delete(spark.createDataFrame([("d0007",)], "doc_id string"))
    want = held(store)
    assert store.compact("documents") is None  # few and small
    merged = store.compact("documents", most=3)
    assert (merged.kind, merged.low, merged.high) == ("r", 1, 6)
    assert [s.path for s in store.log("documents").live()] == [base.path, merged.path]
    assert held(store) == want and len(want) == 4999
    assert store.vacuum("documents") == 7 and held(store) == want
    folded = store.compact("documents", share=0.0)
    assert (folded.kind, folded.low, folded.high) == ("b", 0, 6)
    assert store.vacuum("documents") == 2 and held(store) == want
    store.replace("documents", docs(spark, [("d0007", "back", 7)]))
    assert len(held(store)) == 5000


def test_a_write_that_died_does_not_count(spark, store):
    store.replace("documents", docs(spark, [("a", "x", 1)]))
    half = store.replace("documents", docs(spark, [("a", "half", 2)]))
    import pathlib

    pathlib.Path(half.path.removeprefix("file:"), "_SUCCESS").unlink()
    assert held(store) == [("a", "x", 1)]
    store.replace("documents", docs(spark, [("a", "whole", 3)]))
    assert held(store) == [("a", "whole", 3)]
    assert len(store.log("documents").live()) == 2


def test_lookup_prunes_by_hash(spark, store):
    store.replace("documents", docs(spark, [(f"d{i}", "x", i) for i in range(50)]))
    one = store.read("documents", "d7")
    assert [r.n for r in one.collect()] == [7]
    assert "PushedFilters: [IsNotNull(_hash)" in one._jdf.queryExecution().executedPlan().toString() or "_hash" in one._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="nothing is stored"):
        store.read("briefs")
