"""Hit lists are put in order many to a batch, and as a plain re-telling of the rule does it."""

import math

from pyspark.sql import functions as F

from lectern.functions import fixed as X
from lectern.operators import rerank


def told(rows):
    left, picked = sorted(rows, key=lambda r: r["rank"]), []
    while left:
        def value(r):
            near = sum(X.MMR_SAME_DOC * ((p["doc_id"] or "") == (r["doc_id"] or "")) + X.MMR_SAME_SECTION * (p["section_id"] == r["section_id"]) for p in picked)
            return math.floor((X.MMR_LAMBDA * r["score"] - (1.0 - X.MMR_LAMBDA) * near) * 1e9 + 0.5)

        best = max(left, key=value)  # the first of equals
        picked.append(best)
        left.remove(best)
    return [r["chunk_id"] for r in picked]


def test_order_and_plan(spark):
    rows = [
        dict(request_id=f"r{q}", chunk_id=f"d{i % 4}_{i}", doc_id=None if i == 5 else f"d{i % 4}", section_id=None if i % 3 == 2 else f"s{i % 3}", score=((q * 31 + i * 17) % 7) / 7, rank=i + 1)
        for q in range(40) for i in range(q % 9)
    ]
    hits = spark.createDataFrame(rows, "request_id string, chunk_id string, doc_id string, section_id string, score double, rank int")
    got = rerank.diversify(hits, most=9)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    lists = {r.request_id: [x["chunk_id"] for x in r.l] for r in got.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("l")).collect()}
    assert len(lists) == 35
    for q, order in lists.items():
        assert order == told([r for r in rows if r["request_id"] == q])
