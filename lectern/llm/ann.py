"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Distinct vectors are dealt by hash into shards of about ``SHARD``. One task builds the graph of
a shard: each vector gets a geometric level; on every level a node is linked to near ones that
are not already reached through a nearer link, and back. A graph is a few flat integer
arrays, written once. A search starts on the sparse top level, walks down, and keeps a beam of
the ``BEAM`` nearest on the lowest level; all queries of a block walk in step, as arrays. Each
cell (shard, block of queries) returns its ``k`` best, scored in double precision on the
original vectors, and the best of all cells win.

Equal vectors are one node that carries its ``k + 1`` smallest ids, which is all a result can
need of them, so a vector that a third of all rows share adds one node.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do null ids; rows that repeat an id count once, with the smallest vector; vectors
of another length are never candidates; ties go to the smaller id; fewer candidates than ``k``
are all returned; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.operators.stage import written

#: Vectors of a shard, and queries of a block, on average.
SHARD, QUERIES = 4096, 1024
#: Links a node chooses, and may hold with those that chose it; nearest it chooses from.
CHOSEN, HELD, NEAREST = 16, 40, 64
#: One in so many nodes is also on the next level.
STEP = 16
BEAM, BEAM_ABOVE = 96, 16
NONE = -1


# --- graph of a shard --------------------------------------------------------------------


def _links(unit: np.ndarray) -> np.ndarray:
    """(nodes, HELD) links among the rows of ``unit``, nearest first, ``NONE`` where there are fewer."""
    n = len(unit)
    out = np.full((n, HELD), NONE, dtype=np.int32)
    if n < 2:
        return out
    near = unit @ unit.T
    np.fill_diagonal(near, -np.inf)
    width = min(NEAREST, n - 1)
    order = np.argpartition(-near, width - 1, axis=1)[:, :width]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, axis=1), axis=1, kind="stable"), axis=1)
    rows = np.arange(n)
    chosen = np.full((n, CHOSEN), NONE, dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    for c in range(width):
        candidate = order[:, c]
        # reached already if one of the chosen is nearer to the candidate than the node is
        through = np.where(chosen != NONE, near[candidate[:, None], chosen], -np.inf).max(axis=1)
        take = (count < CHOSEN) & (through < near[rows, candidate])
        chosen[rows[take], count[take]] = candidate[take]
        count[take] += 1
    source = np.repeat(rows, CHOSEN)[chosen.ravel() != NONE]
    target = chosen.ravel()[chosen.ravel() != NONE]
    pairs = np.unique(np.r_[source * n + target, target * n + source])
    a, b = pairs // n, pairs % n
    by = np.lexsort((-near[a, b], a))
    a, b = a[by], b[by]
    place = np.arange(len(a)) - np.searchsorted(a, a, side="left")
    keep = place < HELD
    out[a[keep], place[keep]] = b[keep]
    return out


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: vectors, ids, and for each level its nodes and their links."""
    rows = rows.sort_values("rep", kind="stable")
    vectors = np.array(rows["embedding"].tolist(), dtype=np.float32)
    unit = vectors / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]
    unit = unit.astype(np.float32)
    levels = np.random.default_rng(len(rows)).geometric(1 - 1 / STEP, len(rows)) - 1
    nodes, links = [], []
    for level in range(int(levels.max()) + 1):
        own = np.flatnonzero(levels >= level).astype(np.int32)
        nodes.append(own.tobytes())
        links.append(_links(unit[own]).tobytes())
    width = max(map(len, rows["ids"]))
    ids = np.zeros((len(rows), width), dtype=np.int64)
    for i, own in enumerate(rows["ids"]):
        ids[i, : len(own)] = own
    return pd.DataFrame({
        "dim": [vectors.shape[1]], "shard": [rows["shard"].iloc[0]], "vectors": [vectors.tobytes()], "ids": [ids.tobytes()],
        "id_counts": [np.array([len(x) for x in rows["ids"]], dtype=np.int32).tobytes()], "nodes": [nodes], "links": [links],
    })


INDEX = "dim int, shard long, vectors binary, ids binary, id_counts binary, nodes array<binary>, links array<binary>"


# --- search ------------------------------------------------------------------------------


def beam(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
    """(queries, width) nodes found from ``entries`` (queries, some), nearest first, ``NONE`` where there are fewer."""
    n_queries = len(queries)
    seen = np.zeros((n_queries, len(unit) + 1), dtype=bool)  # the last column is NONE
    seen[:, NONE] = True
    found = np.full((n_queries, width + links.shape[1]), NONE, dtype=np.int64)
    near = np.full(found.shape, -np.inf, dtype=np.float32)
    spent = np.ones(found.shape, dtype=bool)

    def look(who: np.ndarray, nodes: np.ndarray) -> None:
        fresh = ~seen[who[:, None], nodes]
        nodes = np.where(fresh, nodes, NONE)
        for c in range(nodes.shape[1]):  # a node twice in one row counts once
            again = seen[who, nodes[:, c]]
            nodes[again, c] = NONE
            seen[who, nodes[:, c]] = True
        score = np.where(nodes == NONE, -np.inf, np.einsum("qwd,qd->qw", unit[nodes], queries[who]))
        all_nodes = np.concatenate([found[who, :width], nodes], axis=1)
        all_near = np.concatenate([near[who, :width], score], axis=1)
        all_spent = np.concatenate([spent[who, :width], nodes == NONE], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        found[who, :width] = np.take_along_axis(all_nodes, best, axis=1)
        near[who, :width] = np.take_along_axis(all_near, best, axis=1)
        spent[who, :width] = np.take_along_axis(all_spent, best, axis=1)

    look(np.arange(n_queries), entries)
    while True:
        who = np.flatnonzero(~spent[:, :width].all(axis=1))
        if not len(who):
            return found[:, :width]
        at = np.argmin(spent[who, :width], axis=1)  # the nearest that is not spent
        spent[who, at] = True
        look(who, links[found[who, at]].astype(np.int64))


def search(index: dict, queries: np.ndarray, width: int) -> np.ndarray:
    """Walk down the levels; (queries, width) rows of the shard."""
    unit, at = index["unit"], None
    for level in reversed(range(len(index["nodes"]))):
        nodes, links = index["nodes"][level], index["links"][level]
        if at is None:
            entries = np.zeros((len(queries), 1), dtype=np.int64)
        else:  # nodes of a level are on all lower ones
            entries = np.where(at == NONE, NONE, np.searchsorted(nodes, at))
        local = beam(unit[nodes], links, queries, entries, width if level == 0 else BEAM_ABOVE)
        at = np.where(local == NONE, NONE, nodes[local])
    return at


def _search_cell(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(index) or not len(queries):
            return empty
        row = index.iloc[0]
        vectors = np.frombuffer(row["vectors"], dtype=np.float32).reshape(-1, row["dim"]).astype(np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        counts = np.frombuffer(row["id_counts"], dtype=np.int32)
        ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(len(vectors), -1)
        graph = {
            "unit": (vectors / norms[:, None]).astype(np.float32),
            "nodes": [np.frombuffer(x, dtype=np.int32) for x in row["nodes"]],
            "links": [np.frombuffer(x, dtype=np.int32).reshape(-1, HELD) for x in row["links"]],
        }
        asked = np.array(queries["embedding"].tolist(), dtype=np.float32).astype(np.float64)
        asked_norms = np.linalg.norm(asked, axis=1)
        query_ids = queries["query_id"].to_numpy(dtype=np.int64)
        out: list[tuple[int, int, float]] = []
        for start in range(0, len(asked), QUERIES):
            part = slice(start, start + QUERIES)
            at = search(graph, (asked[part] / asked_norms[part, None]).astype(np.float32), BEAM)
            for q, own, vector, norm in zip(query_ids[part], at, asked[part], asked_norms[part]):
                own = own[own != NONE]
                scores = np.clip((vectors[own] @ vector) / (norms[own] * norm), -1.0, 1.0)
                hits = [(-s, int(i)) for s, node in zip(scores.tolist(), own) for i in ids[node, : counts[node]] if i != q]
                out.extend((int(q), i, -s) for s, i in sorted(hits)[:k])
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part, one row an id."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(e, lambda x: x != 0)
    ok = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & some)
    plain = ok.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<float>").alias("embedding"))
    return plain.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def build(vectors: DataFrame, k: int) -> DataFrame:
    """The index: one row for each shard."""
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= k + 1)
    nodes = written(few.groupBy("dim", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    dealt = nodes.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")))
    return written(dealt.groupBy("dim", "shard").applyInPandas(_build, INDEX), "graphs")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``is_query``.

    A cell is a shard and a block of queries; index rows are copied to the blocks, queries to
    the shards, and a task holds one cell at a time.
    """
    vectors = written(usable(vectors), "vectors")
    index = build(vectors, k)
    asked = vectors.where(is_query).select("dim", F.col("vec_id").alias("query_id"), "embedding")
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))  # like blocks, one row for each length of vectors
    left = index.join(F.broadcast(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = asked.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    right = right.join(F.broadcast(shards), "dim").select("dim", "block", "query_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard"))
    cells = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
    found = cells.applyInPandas(_search_cell(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
