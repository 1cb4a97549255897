"""Exact cosine top-k inside a scope.

Vectors and request vectors of a scope are cut into blocks of bounded size (from
counts, so a hot scope gets many blocks). Each pair of blocks is one task-sized matrix
product that emits only its own k best per request; the last step merges those.
Scores of pairs never leave the task that computes them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lectern.functions import text as T
from lectern.operators.ranking import top_k
from lectern.operators.stage import written

VECTOR_BLOCK = 4096
REQUEST_BLOCK = 512
#: Cells of a scope, at most; beyond its square the cells grow instead.
MOST_CELLS = 1 << 16


def _blocks(df: DataFrame, name: str, size: int, row_key: str) -> DataFrame:
    """Spread each scope's rows over ceil(n / size) blocks by a hash of the row key."""
    n = df.groupBy("scope_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return df.join(n, "scope_id").withColumn(
        name, F.pmod(F.xxhash64(F.col(row_key), F.lit(17)), F.col(f"{name}s")).cast("int")
    )


def _block_top_k(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"request_id": [], "scope_id": [], "pos": [], "score": []})
    if left.empty or right.empty:
        return empty
    stored = np.stack(left["embedding"].to_numpy()).astype(np.float64)
    asked = np.stack(right["embedding"].to_numpy()).astype(np.float64)

    def unit(m: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    sims = np.maximum(unit(asked) @ unit(stored).T, 0.0)
    sims = np.floor(sims * 1e6 + 0.5) / 1e6
    pos = left["pos"].to_numpy()
    by_pos = np.argsort(pos, kind="stable")
    sims, pos = sims[:, by_pos], pos[by_pos]
    parts = []
    for i, (request, k) in enumerate(zip(right["request_id"], right["k"])):
        best = np.argsort(-sims[i], kind="stable")[: int(k)]
        parts.append(
            pd.DataFrame(
                {"request_id": request, "scope_id": right["scope_id"].iat[0], "pos": pos[best], "score": sims[i][best]}
            )
        )
    return pd.concat(parts) if parts else empty


def nearest(vectors: DataFrame, requests: DataFrame, max_k: int = 400) -> DataFrame:
    """``vectors``: scope_id, pos, embedding. ``requests``: request_id, scope_id, embedding, k.

    Returns request_id, scope_id, pos, score (0..1, six digits), rank; ties by pos.
    """
    # aliases give both sides their own columns where they stem from one table
    own = lambda df, *names: df.select(*[F.col(n).alias(n) for n in names])
    stored = _blocks(own(vectors, "scope_id", "pos", "embedding"), "v_block", VECTOR_BLOCK, "pos")
    asked = _blocks(own(requests, "request_id", "scope_id", "embedding", "k"), "r_block", REQUEST_BLOCK, "request_id")
    stored_blocks = stored.select("scope_id", "v_blocks").distinct()
    asked_blocks = asked.select("scope_id", "r_blocks").distinct()
    stored = (
        stored.join(asked_blocks, "scope_id")
        .withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
        .select("scope_id", "v_block", "r_block", "pos", "embedding")
    )
    asked = (
        asked.join(stored_blocks, "scope_id")
        .withColumn("v_block", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
        .select("scope_id", "v_block", "r_block", "request_id", "embedding", "k")
    )
    keys = ["scope_id", "v_block", "r_block"]
    request_type = requests.schema["request_id"].dataType.simpleString()
    partial = (
        stored.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(_block_top_k, f"request_id {request_type}, scope_id string, pos long, score double")
    )
    partial = partial.join(requests.select("request_id", "k"), "request_id")
    best = top_k(partial, ["request_id"], [F.col("score").desc(), F.col("pos")], "k", "rank", most=max_k).drop("k")
    return written(best, "nearest")


# --- exact search that skips cells -----------------------------------------------------------


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Each vector with its nearest centre and the distance to it, between unit vectors."""
    centres = centres.sort_values("cell", kind="stable")
    away = _distances(_unit(rows["embedding"]), _unit(centres["embedding"]))
    near = away.argmin(axis=1)
    return rows[["scope_id", "pos", "embedding"]].assign(cell=centres["cell"].to_numpy()[near], away=away[np.arange(len(rows)), near])


def _reach(asked: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """For each request and cell the score that no vector of the cell exceeds."""
    away = _distances(_unit(asked["embedding"]), _unit(cells["embedding"]))
    least = np.maximum(away - cells["radius"].to_numpy()[None, :], 0.0)
    n = len(cells)
    return pd.DataFrame(
        {
            "request_id": np.repeat(asked["request_id"].to_numpy(), n), "scope_id": asked["scope_id"].iat[0], "k": np.repeat(asked["k"].to_numpy(), n),
            "cell": np.tile(cells["cell"].to_numpy(), len(asked)), "n": np.tile(cells["n"].to_numpy(), len(asked)),
            "bound": np.maximum(1.0 - least * least / 2.0, 0.0).ravel(),
        }
    )


@dataclass
class Cells:
    """Vectors (scope_id, pos, embedding, cell) and their cells (scope_id, cell, embedding, radius, n)."""

    vectors: DataFrame
    cells: DataFrame


def in_cells(vectors: DataFrame) -> Cells:
    """Deal the vectors of each scope over about the root of their number of cells, round centres
    that are vectors drawn by a hash of ``pos``. Every vector is dealt; the radius of a cell is the
    distance of its outermost one."""
    own = vectors.select("scope_id", F.col("pos").cast("long").alias("pos"), "embedding")
    counted = own.groupBy("scope_id").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int").alias("_cells"))
    drawn = own.select("scope_id", "pos").join(counted, "scope_id")
    # the hash leaves about twice as many as wanted, so that the ranking reads few rows
    n = F.col("_cells").cast("double")
    draw = F.pmod(F.xxhash64("pos", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    few = drawn.where((draw * n < 2.0) | (F.col("_cells") <= 64)).withColumn("_h", F.xxhash64("pos", F.lit(3)))
    picked = top_k(few, ["scope_id"], [F.col("_h"), F.col("pos")], "_cells", "cell", most=MOST_CELLS).select("scope_id", "pos", "cell")
    centres = written(own.join(picked, ["scope_id", "pos"]).select("scope_id", "cell", "embedding"), "cell-centres")
    blocked = _blocks(own, "v_block", VECTOR_BLOCK, "pos")
    spread = centres.join(blocked.select("scope_id", "v_blocks").distinct(), "scope_id").withColumn("v_block", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
    keys = ["scope_id", "v_block"]
    dealt = blocked.select(*keys, "pos", "embedding").groupBy(*keys).cogroup(spread.select(*keys, "cell", "embedding").groupBy(*keys)).applyInPandas(
        _assign, "scope_id string, pos long, embedding array<float>, cell int, away double"
    )
    dealt = written(dealt, "vectors-in-cells")
    sizes = dealt.groupBy("scope_id", "cell").agg((F.max("away") + 1e-9).alias("radius"), F.count(F.lit(1)).alias("n"))
    return Cells(dealt, written(centres.join(sizes, ["scope_id", "cell"]), "cells"))


def nearest_in_cells(found: Cells, requests: DataFrame, max_k: int = 400) -> tuple[DataFrame, DataFrame]:
    """The rows of ``nearest``, and a report (request_id, n_cells, cells_read, n_vectors, vectors_read).

    By the triangle inequality a vector of a cell is no nearer than the distance to its centre less
    its radius. A request first reads the cells with the highest bounds until they hold k vectors;
    the k-th score is a floor, and of the other cells only those whose bound reaches it are read.
    """
    own = requests.select("request_id", "scope_id", "embedding", "k").join(found.cells.select("scope_id").distinct(), "scope_id", "left_semi")
    blocked = _blocks(own, "r_block", REQUEST_BLOCK, "request_id")
    spread = found.cells.join(blocked.select("scope_id", "r_blocks").distinct(), "scope_id").withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
    keys = ["scope_id", "r_block"]
    kind = requests.schema["request_id"].dataType.simpleString()
    k_kind = requests.schema["k"].dataType.simpleString()
    bounds = blocked.select(*keys, "request_id", "embedding", "k").groupBy(*keys).cogroup(
        spread.select(*keys, "cell", "embedding", "radius", "n").groupBy(*keys)
    ).applyInPandas(_reach, f"request_id {kind}, scope_id string, k {k_kind}, cell int, n long, bound double")
    bounds = written(bounds, "cell-bounds")
    ahead = F.sum("n").over(Window.partitionBy("request_id").orderBy(F.col("bound").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1))
    first = written(bounds.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).where(F.col("_ahead") < F.col("k")).drop("_ahead"), "cells-first")

    def read(cells: DataFrame) -> DataFrame:
        visit = F.concat_ws("\u0001", "scope_id", F.col("cell").cast("string"))
        asked = cells.select("request_id", "cell").join(own, "request_id").select(
            F.struct("request_id", "cell").alias("_r"), visit.alias("scope_id"), "embedding", "k"
        )
        # a request is one row a cell, so it is named by both
        named = asked.withColumn("request_id", F.to_json("_r"))
        stored = found.vectors.select(visit.alias("scope_id"), "pos", "embedding").join(named.select("scope_id").distinct(), "scope_id", "left_semi")
        hits = nearest(stored, named.select("request_id", "scope_id", "embedding", "k"), max_k)
        back = F.from_json("request_id", f"struct<request_id:{kind},cell:int>")
        return hits.select(back["request_id"].alias("request_id"), F.substring_index("scope_id", "\u0001", 1).alias("scope_id"), "pos", "score")

    order = [F.col("score").desc(), F.col("pos")]
    ks = own.select("request_id", "k")
    early = written(top_k(read(first).join(ks, "request_id"), ["request_id"], order, "k", "rank", most=max_k), "nearest-early")
    floors = early.where(F.col("rank") == F.col("k")).select("request_id", F.col("score").alias("_floor"))
    rest = bounds.join(first.select("request_id", "cell"), ["request_id", "cell"], "left_anti").join(floors, "request_id", "left")
    # scores are rounded to six digits
    late = written(rest.where("_floor is null or bound >= _floor - 1e-6").drop("_floor"), "cells-late")
    both = early.drop("rank", "k").unionByName(read(late))
    best = written(top_k(both.join(ks, "request_id"), ["request_id"], order, "k", "rank", most=max_k).drop("k"), "nearest-in-cells")
    visited = first.unionByName(late).groupBy("request_id").agg(F.count(F.lit(1)).alias("cells_read"), F.sum("n").alias("vectors_read"))
    report = bounds.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_vectors")).join(visited, "request_id")
    return best, report


def embedding_text(text, prefix, formula_ids):
    """What an embedding model is given for a chunk."""
    return T.search_text(text, prefix, formula_ids, sep="\n")


def flatten_metadata(chunks: DataFrame) -> DataFrame:
    """Chunk metadata as stored beside a vector: empty lists and missing pages are left out."""
    m = F.col("metadata")
    none_if_empty = lambda c: F.when(F.size(c) > 0, c)
    return chunks.select(
        "doc_id",
        "pos",
        "chunk_id",
        "text",
        "layer",
        *[
            m[name].alias(name)
            for name in (
                "section_id section_type page_start page_end chapter difficulty_score has_formula "
                "content_type caption contextual_prefix content_source enhanced"
            ).split()
        ],
        *[none_if_empty(m[name]).alias(name) for name in ("formula_ids", "cross_refs", "referenced_by")],
    )


def restore_metadata(flat: DataFrame) -> DataFrame:
    """Inverse of ``flatten_metadata`` with the defaults of missing fields."""
    blank = lambda n: F.coalesce(F.col(n), F.lit("")).alias(n)
    items = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>")).alias(n)
    return flat.select(
        "doc_id",
        "pos",
        "chunk_id",
        "text",
        F.coalesce("layer", F.lit("L2")).alias("layer"),
        F.struct(
            blank("section_id"),
            F.coalesce("section_type", F.lit("prose")).alias("section_type"),
            F.col("page_start"),
            F.col("page_end"),
            blank("chapter"),
            F.coalesce("difficulty_score", F.lit(0.5)).alias("difficulty_score"),
            F.coalesce("has_formula", F.lit(False)).alias("has_formula"),
            items("formula_ids"),
            items("cross_refs"),
            F.coalesce("content_type", F.lit("text")).alias("content_type"),
            blank("caption"),
            items("referenced_by"),
            F.col("doc_id").alias("doc_id"),
            blank("contextual_prefix"),
            F.coalesce("content_source", F.lit("parser")).alias("content_source"),
            F.coalesce("enhanced", F.lit(False)).alias("enhanced"),
        ).alias("metadata"),
    )
