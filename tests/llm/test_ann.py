import numpy as np
from pyspark.sql import functions as F

from lectern.llm import ann


def brute(rows, is_query, k=5):
    ok = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = min(ok.get(i, v), v)
    out = {}
    for q, a in ok.items():
        if not is_query(q):
            continue
        a = np.array(a, dtype=np.float32).astype(float)
        scored = []
        for i, b in ok.items():
            if i != q and len(b) == len(a):
                b = np.array(b, dtype=np.float32).astype(float)
                scored.append((-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def run(spark, rows, every):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "mine") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(2500)]
    got, want = run(spark, rows, 50), brute(rows, lambda i: i % 50 == 0)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 5 * len(want)
    true = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - true[q, i]) < 1e-12 for q in got for i, s in got[q] if (q, i) in true)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(0, same), *((i, same) for i in range(100, 140)), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (10, [None, 1.0, 1.0])]
    rows += [(None, same), (12, [1.0, 1.0]), (14, [5.0, 1.0, 1.0]), (14, [5.0, 1.0, 1.0]), (16, [-1.0, -2.0, -3.0])]
    got = run(spark, rows, 2)
    want = brute(rows, lambda i: i % 2 == 0)
    assert got.keys() == {q for q in want if want[q]}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert run(spark, [], 2) == {}


def test_graph_reaches_every_node():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(600, 16)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = ann._links(unit)
    found = ann.beam(unit, links, unit, np.zeros((600, 1), dtype=np.int64), ann.BEAM)
    assert (found[:, 0] == np.arange(600)).mean() > 0.98
