"""Context expansion: neighbours and related chunks of the hits, admitted in order.

Which chunks are related to a hit is found by equi-joins. Which of them enter depends on
what entered before, so admission goes through one request's hits in an Arrow function.

Its input is bounded without losing a chunk. A chunk goes by its copy: the print of a slide,
else its id. A context holds at most ``limit`` copies, so of a hit's candidates, one for each
copy, in storage order, at most ``limit`` are in it already and at most ``limit`` can enter:
the first 2 x limit decide. The same holds for each key that brings candidates, as a copy
comes no later in the list of a hit than in the list of the key.
"""

from __future__ import annotations

from functools import reduce
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import text as T

FLAT = (
    "section_id section_type content_type page_start has_formula formula_ids cross_refs referenced_by caption "
    "contextual_prefix"
).split()


def flat(chunks: DataFrame) -> DataFrame:
    """Chunks with the metadata fields that expansion reads as plain columns."""
    return chunks.select("doc_id", "pos", "chunk_id", "text", *[F.col(f"metadata.{c}").alias(c) for c in FLAT])


def _copy(slide: Column, fingerprint: Column, chunk_id: Column) -> Column:
    return F.when(slide & (fingerprint != ""), F.concat(F.lit("print "), fingerprint)).otherwise(
        F.concat(F.lit("id "), chunk_id)
    )


def _first_of(stored: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates of each asked key that can decide for its largest limit."""
    wanted = asked.groupBy(*keys).agg(F.max("limit").alias("_limit"))
    once = stored.groupBy(*keys, "copy").agg(F.min("c_pos").alias("c_pos")).join(wanted, keys)
    ranked = once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("c_pos")))
    return ranked.where(F.col("_n") <= 2 * F.col("_limit") + 1).drop("_n", "_limit")


def candidates(hits: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """request_id, hit_rank, stage, c_pos, factor: what each hit may bring, in scan order."""
    h = hits.join(requests.select("request_id", "message", "intent", "limit"), "request_id").withColumn(
        "slide", T.is_slide(F.col("content_type"), F.col("section_type"), F.col("section_id"))
    )
    refs = lambda: F.array_distinct(F.concat("cross_refs", "referenced_by"))
    slide = T.is_slide(F.col("content_type"), F.col("section_type"), F.col("section_id"))
    # an inner join, as a semi-join would be moved below the columns and texts with it
    stored = chunks.select(
        "doc_id",
        F.col("pos").alias("c_pos"),
        F.col("chunk_id").alias("c_id"),
        F.col("section_id").alias("c_section"),
        F.col("section_type").alias("c_type"),
        F.col("page_start").alias("c_page"),
        F.col("has_formula").alias("c_formula"),
        F.col("formula_ids").alias("c_formula_ids"),
        refs().alias("c_refs"),
        _copy(slide, T.fingerprint(F.col("text")), F.col("chunk_id")).alias("copy"),
    ).where(F.coalesce("c_id", F.lit("")) != "").join(h.select("doc_id").distinct(), "doc_id")
    hit = ["request_id", F.col("rank").alias("hit_rank"), "doc_id", "pos", "limit"]
    near = lambda *offsets: F.explode(F.array(*[F.col("pos") + o for o in offsets])).alias("c_pos")
    result = ["request_id", "hit_rank", "stage", "c_pos", "factor"]
    tag = lambda df, stage, factor: df.withColumn("stage", F.lit(stage)).withColumn("factor", F.lit(factor)).select(*result)

    slides = (
        h.where(F.col("slide") & (T.slide_budget(F.col("intent"), F.col("rank"), F.col("message")) > 0))
        .select(*hit, "page_start", near(-2, -1, 1, 2))
        .join(stored.select("doc_id", "c_pos", "c_page"), ["doc_id", "c_pos"])
        .where(F.abs(F.col("c_page") - F.col("page_start")) <= 1)
    )
    papers = h.where(~F.col("slide"))
    sectioned = papers.where(F.coalesce("section_id", F.lit("")) != "")
    neighbours = (
        sectioned.select(*hit, "section_id", near(-1, 1))
        .join(stored.select("doc_id", "c_pos", "c_section"), ["doc_id", "c_pos"])
        .where(F.col("c_section") == F.col("section_id"))
    )

    # by reference: a shared reference, or one names the other
    visual = (
        (F.col("intent") == "figure")
        | F.col("content_type").isin("figure", "table")
        | (F.coalesce("caption", F.lit("")) != "")
    )
    pointing = papers.where(visual).select(
        *hit,
        F.explode(
            F.concat(
                F.transform(refs(), lambda r: F.struct(r.alias("key"), F.lit("ref").alias("kind"))),
                F.transform(refs(), lambda r: F.struct(r.alias("key"), F.lit("id").alias("kind"))),
                F.array(F.struct(F.col("chunk_id").alias("key"), F.lit("ref").alias("kind"))),
            )
        ).alias("k"),
    ).select("request_id", "hit_rank", "doc_id", "pos", "limit", F.col("k.key").alias("key"), F.col("k.kind").alias("kind"))
    pointed = stored.select("doc_id", "c_pos", "copy", F.explode("c_refs").alias("key"), F.lit("ref").alias("kind")).unionByName(
        stored.select("doc_id", "c_pos", "copy", F.col("c_id").alias("key"), F.lit("id").alias("kind"))
    )
    by_key = ["doc_id", "key", "kind"]
    by_ref = pointing.join(_first_of(pointed, pointing, by_key), by_key)

    # same section: formula chunks for formula questions, same type for the others
    formula = sectioned.where(F.col("intent") == "formula")
    with_flag = formula.where(F.col("has_formula")).select(*hit, F.col("section_id").alias("c_section"))
    by_section = ["doc_id", "c_section"]
    by_flag = with_flag.join(_first_of(stored.where(F.col("c_formula")), with_flag, by_section), by_section)
    with_ids = formula.select(*hit, F.col("section_id").alias("c_section"), F.explode("formula_ids").alias("fid"))
    by_formula = ["doc_id", "c_section", "fid"]
    by_id = with_ids.join(_first_of(stored.withColumn("fid", F.explode("c_formula_ids")), with_ids, by_formula), by_formula)
    typed_hits = sectioned.where(
        ((F.col("intent") == "method") & (F.col("section_type") == "method"))
        | (
            F.col("intent").isin("concept", "detail")
            & (F.coalesce("section_type", F.lit("")) != "")
            & (F.col("section_type") != "prose")
        )
    ).select(*hit, F.col("section_id").alias("c_section"), F.col("section_type").alias("c_type"))
    by_kind = ["doc_id", "c_section", "c_type"]
    by_type = typed_hits.join(_first_of(stored, typed_hits, by_kind), by_kind)

    related = reduce(DataFrame.unionByName, [p.select("request_id", "hit_rank", "pos", "limit", "copy", "c_pos") for p in (by_ref, by_flag, by_id, by_type)])
    # one row for each copy of a hit, and no more of them than can decide
    related = related.where(F.col("c_pos") != F.col("pos")).groupBy("request_id", "hit_rank", "limit", "copy").agg(F.min("c_pos").alias("c_pos"))
    nth = Window.partitionBy("request_id", "hit_rank").orderBy("c_pos")
    related = tag(related.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= 2 * F.col("limit")), 0, 0.9)
    return related.unionByName(tag(slides, 0, 0.85)).unionByName(tag(neighbours, 1, 0.85))


def _fresh(rows: list[dict], ids: set[str], copies: set[str]) -> list[dict]:
    """The first row of each id, then of each copy, that is not in the context yet."""
    by_id: dict[str, dict] = {}
    for row in rows:
        if row["chunk_id"]:
            by_id.setdefault(row["chunk_id"], row)
    by_copy: dict[str, dict] = {}
    for row in by_id.values():
        by_copy.setdefault(row["copy"], row)
    return [row for row in by_copy.values() if row["chunk_id"] not in ids and row["copy"] not in copies]


def _admit(table: pa.Table) -> pa.Table:
    """The context of one request: its hits, then what each hit in turn may still bring.

    A request has few rows, so they are plain ones: a frame for every step would cost far more than the step.
    """
    turns: dict[int, list[dict]] = {}
    for row in sorted(table.to_pylist(), key=itemgetter("stage", "pos")):
        turns.setdefault(-1 if row["stage"] < 0 else row["hit_rank"], []).append(row)
    ids: set[str] = set()
    copies: set[str] = set()
    out: list[dict] = []
    for turn, rows in sorted(turns.items()):
        if turn < 0:
            entering = _fresh(sorted(rows, key=itemgetter("hit_rank")), ids, copies)
        else:
            entering = _fresh([row for row in rows if row["pos"] != row["hit_pos"]], ids, copies)
            if rows[0]["budget"] >= 0:
                entering = entering[: 2 * rows[0]["budget"]]
        entering = entering[: rows[0]["limit"] - len(out)]
        ids.update(row["chunk_id"] for row in entering)
        copies.update(row["copy"] for row in entering)
        out += entering
    same = [table.schema.field(c) for c in ("request_id", "doc_id")]
    made = [
        row if row["stage"] < 0 else row | {"score": row["hit_score"] * row["factor"], "source": "context_expanded"} for row in out
    ]
    ranked = [
        row | {"rank": row["hit_rank"] if row["stage"] < 0 else n, "context_no": n} for n, row in enumerate(made, 1)
    ]
    return pa.Table.from_pylist(
        ranked,
        pa.schema([
            *same, ("pos", pa.int64()), ("chunk_id", pa.string()), ("score", pa.float64()), ("source", pa.string()),
            ("rank", pa.int32()), ("context_no", pa.int32()),
        ]),
    )


def expand(hits: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` and ``chunks`` flat, ``requests``: request_id, message, intent, limit.

    Returns request_id, doc_id, pos, chunk_id, score, source, rank, context_no.
    """
    requests = requests.where(F.col("limit") > 0)
    slide = T.is_slide(F.col("content_type"), F.col("section_type"), F.col("section_id"))
    asked = requests.select("request_id", "message", "intent", "limit")
    budget = F.when(slide, T.slide_budget(F.col("intent"), F.col("rank"), F.col("message"))).otherwise(-1)
    narrow = hits.select(  # texts stay where they are
        "request_id", "doc_id", "pos", "chunk_id", "score", "source", "rank", "content_type", "section_type", "section_id",
        _copy(slide, T.fingerprint(F.col("text")), F.col("chunk_id")).alias("copy"),
    )
    base = narrow.join(asked, "request_id").select(
        "request_id", "doc_id", "pos", "chunk_id", "score", "source", "limit",
        F.col("rank").alias("hit_rank"), F.lit(-1).alias("stage"), F.lit(1.0).alias("factor"), "copy",
        F.col("pos").alias("hit_pos"), F.col("score").alias("hit_score"), budget.cast("int").alias("budget"),
    )
    offers = candidates(hits, asked, chunks).withColumnRenamed("c_pos", "pos")
    owner = base.select(
        "request_id", "hit_rank", "doc_id", "limit", "hit_pos", "hit_score", "budget"
    )
    offered = offers.join(owner, ["request_id", "hit_rank"]).join(
        chunks.select("doc_id", "pos", "chunk_id", _copy(slide, T.fingerprint(F.col("text")), F.col("chunk_id")).alias("copy")),
        ["doc_id", "pos"],
    ).withColumn("score", F.col("hit_score")).withColumn("source", F.lit("context_expanded"))
    kind = hits.schema["request_id"].dataType.simpleString()
    doc = hits.schema["doc_id"].dataType.simpleString()
    return (
        base.unionByName(offered.select(*base.columns))
        .groupBy("request_id")
        .applyInArrow(
            _admit,
            f"request_id {kind}, doc_id {doc}, pos long, chunk_id string, score double, source string, rank int, context_no int",
        )
    )


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Chunks within ``reach`` storage places of a hit, in the same section."""
    offsets = [o for o in range(-reach, reach + 1) if o]
    probes = hits.select(
        "request_id", "doc_id", F.col("pos").alias("hit_pos"), "section_id",
        F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"),
    ).withColumn("pos", F.col("hit_pos") + F.col("offset"))
    return probes.join(
        chunks.select("doc_id", "pos", "chunk_id", F.col("section_id").alias("c_section")), ["doc_id", "pos"]
    ).where((F.col("section_id") != "") & (F.col("section_id") == F.col("c_section"))).drop("c_section")
