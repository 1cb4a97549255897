"""Admission to a context costs little for each request."""

import time

import pyarrow as pa

from lectern.operators import expand


def offers(request):
    row = {"request_id": request, "doc_id": "d", "limit": 6, "hit_score": 0.5, "budget": -1, "source": "hit"}
    hits = [row | {"pos": 10 * n, "chunk_id": f"c{10 * n}", "copy": f"id c{10 * n}", "score": 1.0 / n, "hit_rank": n, "stage": -1, "factor": 1.0, "hit_pos": 10 * n} for n in (2, 1)]
    near = [
        row | {"pos": 10 * n + o, "chunk_id": f"c{10 * n + o}", "copy": f"id c{min(10 * n + o, 22)}", "score": 0.5, "hit_rank": n, "stage": 1, "factor": 0.8, "hit_pos": 10 * n}
        for n in (1, 2) for o in (-1, 0, 1, 2, 3)
    ]
    return pa.Table.from_pylist(hits + near)


def test_rules_and_cost():
    one, started = offers(7), time.time()
    for _ in range(500):
        got = expand._admit(one)
    assert time.time() - started < 3
    rows = got.to_pylist()
    assert [r["chunk_id"] for r in rows] == ["c10", "c20", "c9", "c11", "c12", "c13"]
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5, 6] and [r["source"] for r in rows[1:3]] == ["hit", "context_expanded"]
    assert [r["score"] for r in rows] == [1.0, 0.5] + [0.4] * 4
    wide = expand._admit(offers(7).set_column(2, "limit", pa.array([20] * 12))).to_pylist()
    assert [r["chunk_id"] for r in wide][6:] == ["c19", "c21", "c22"]  # c23 is a copy of c22
