"""Vector search that skips cells gives the rows of the plain one."""

import numpy as np
import pytest

from lectern.operators import vector


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16)) * 3
    rows = [("all", i, (centres[i % 30] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1800)]
    rows += [("all", 1800 + i, [0.0] * 16) for i in range(5)] + [("all", 1810 + i, rows[7][2]) for i in range(40)]
    rows += [("few", i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(6)]
    vectors = spark.createDataFrame(rows, "scope_id string, pos long, embedding array<float>")
    asked = [(f"r{i}", "all", rows[i * 40 % 1800][2], 1 + i % 9) for i in range(40)] + [("f", "few", rows[3][2], 4), ("more", "few", rows[5][2], 10), ("zero", "all", [0.0] * 16, 6), ("nowhere", "none", [1.0] * 16, 3)]
    return vectors, spark.createDataFrame(asked, "request_id string, scope_id string, embedding array<float>, k int")


def rows(df):
    return sorted((r.request_id, r.scope_id, r["rank"], r.pos, r.score) for r in df.collect())


def test_same_rows_and_fewer_vectors(data):
    vectors, asked = data
    best, report = vector.nearest_in_cells(vector.in_cells(vectors), asked)
    assert rows(best) == rows(vector.nearest(vectors, asked))
    told = {r.request_id: r for r in report.collect()}
    assert told["zero"].vectors_read == told["zero"].n_vectors == 1845
    clustered = [r for name, r in told.items() if name.startswith("r")]
    assert sum(r.vectors_read for r in clustered) < 0.3 * sum(r.n_vectors for r in clustered)
