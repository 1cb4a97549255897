"""Expansion and fusion on small fixtures, expansion against a plain re-telling of its rules."""

import random
import re

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import expand, fusion, lexical, rerank

CHUNK = (
    "doc_id string, pos long, chunk_id string, text string, section_id string, section_type string, content_type string, "
    "page_start int, has_formula boolean, formula_ids array<string>, cross_refs array<string>, referenced_by array<string>, "
    "caption string, contextual_prefix string"
)


def make_chunks(rng, n):
    rows = []
    for i in range(n):
        slide = rng.random() < 0.4
        rows.append(
            (
                "d", i, f"c{i}", rng.choice(["same slide text", f"text {i}", f"other {i}"]),
                rng.choice(["s1", "s2", ""]), "slide" if slide else rng.choice(["method", "results", "prose"]),
                "slide" if slide else rng.choice(["text", "table"]), rng.choice([i, i + 1, None]), rng.random() < 0.4,
                rng.choice([[], ["f1"], ["f2"]]), rng.choice([[], ["c1"], ["Figure 1"]]), rng.choice([[], [], ["c2"]]),
                rng.choice(["", "", "cap"]), "",
            )
        )
    return rows


NAMES = [c.strip().split(" ")[0] for c in CHUNK.split(", ")]


def told(chunks, hits, limit, intent, query):
    """The rules told plainly: all hits, then per hit what it brings, until the limit."""
    by = [dict(zip(NAMES, c)) for c in chunks]
    out, seen, prints = [], set(), set()

    def is_slide(c):
        return c["content_type"] == "slide" or c["section_type"] == "slide" or c["section_id"].startswith("slide_")

    def add(c, score):
        if c["chunk_id"] in seen or len(out) >= limit:
            return False
        if is_slide(c):
            p = re.sub(r"[^0-9a-z ]+", "", " ".join(c["text"].lower().split()))[:320]
            if p in prints:
                seen.add(c["chunk_id"])
                return False
            prints.add(p)
        seen.add(c["chunk_id"])
        out.append((c["chunk_id"], round(score, 6)))
        return True

    for pos, score in hits:
        add(by[pos], score)
    for rank, (pos, score) in enumerate(hits, 1):
        h = by[pos]
        if is_slide(h):
            budget = 0 if intent in ("figure", "detail") else (int(rank <= 1) if intent == "formula" else 1 if intent == "structure" else int(rank <= 2))
            added = 0
            for j in range(max(0, pos - 2), min(len(by), pos + 3)):
                c = by[j]
                if added >= 2 * budget or len(out) >= limit:
                    break
                if j == pos or c["chunk_id"] in seen or None in (c["page_start"], h["page_start"]):
                    continue
                if abs(c["page_start"] - h["page_start"]) <= 1:
                    added += add(c, score * 0.85)
            continue
        refs = set(h["cross_refs"] + h["referenced_by"])
        same = lambda c: bool(h["section_id"]) and h["section_id"] == c["section_id"]
        for j, c in enumerate(by):
            if j == pos or c["chunk_id"] in seen:
                continue
            other = set(c["cross_refs"] + c["referenced_by"])
            visual = intent == "figure" or h["content_type"] in ("figure", "table") or h["caption"]
            by_ref = visual and (c["chunk_id"] in refs or h["chunk_id"] in other or refs & other)
            by_formula = intent == "formula" and same(c) and (
                set(h["formula_ids"]) & set(c["formula_ids"]) or (h["has_formula"] and c["has_formula"])
            )
            t = (h["section_type"], c["section_type"])
            by_type = same(c) and (
                t == ("method", "method") if intent == "method" else intent in ("concept", "detail") and t[0] == t[1] != "prose"
            )
            if by_ref or by_formula or by_type:
                add(c, score * 0.9)
        for j in (pos - 1, pos + 1):
            if 0 <= j < len(by) and by[j]["chunk_id"] not in seen and same(by[j]):
                add(by[j], score * 0.85)
    return out


def test_expansion_matches_the_rules(spark):
    rng = random.Random(11)
    cases, chunk_rows, hit_rows, request_rows = {}, [], [], []
    intents = ["figure", "formula", "structure", "method", "detail", "concept"]
    for n in range(36):
        chunks = make_chunks(rng, 14)
        picks = rng.sample(range(14), 4)
        hits = [(p, 5.0 - i) for i, p in enumerate(picks)]
        intent, limit = intents[n % 6], rng.choice([3, 6, 10, 20])
        cases[n] = told(chunks, hits, limit, intent, "q")
        doc = f"d{n}"
        chunk_rows += [(doc, *c[1:]) for c in chunks]
        hit_rows += [(n, s, i, "bm25", doc, *chunks[p][1:]) for i, (p, s) in enumerate(hits, 1)]
        request_rows.append((n, "q", intent, limit))
    chunks = spark.createDataFrame(chunk_rows, CHUNK)
    hits = spark.createDataFrame(hit_rows, "request_id int, score double, rank int, source string, " + CHUNK)
    requests = spark.createDataFrame(request_rows, "request_id int, message string, intent string, limit int")
    got = {}
    for r in expand.expand(hits, requests, chunks).orderBy("request_id", "context_no").collect():
        got.setdefault(r.request_id, []).append((r.chunk_id, round(r.score, 6)))
    assert got == cases


def test_a_fresh_chunk_behind_many_copies_is_reached(spark):
    """Eight references, 400 candidates with 50 texts, and one fresh chunk behind them all."""
    refs = [f"Figure {i}" for i in range(8)]
    chunks = [("d", 0, "c0", "the hit", "s", "prose", "table", 0, False, [], refs, [], "", "")]
    chunks += [("d", i, f"c{i}", f"slide {i % 50}", "slide_1", "slide", "slide", 0, False, [], refs, [], "", "") for i in range(1, 401)]
    chunks.append(("d", 401, "c401", "fresh", "slide_1", "slide", "slide", 0, False, [], refs[:1], [], "", ""))
    hits = spark.createDataFrame([(1, 2.0, 1, "bm25", *chunks[0])], "request_id int, score double, rank int, source string, " + CHUNK)
    for limit, rows in ((60, 52), (200, 52), (20, 20)):
        requests = spark.createDataFrame([(1, "q", "figure", limit)], "request_id int, message string, intent string, limit int")
        got = expand.expand(hits, requests, spark.createDataFrame(chunks, CHUNK)).collect()
        assert len(got) == rows and (limit < 60 or "c401" in {r.chunk_id for r in got})


def test_overlap_and_memory_boost(spark):
    hits = spark.createDataFrame(
        [(1, 0, 0.03, 1, "s1", "about graphs"), (1, 1, 0.02, 2, "s2", "Self-Attention layers")],
        "request_id int, pos int, score double, rank int, section_id string, text string",
    )
    hints = spark.createDataFrame([(1, "", ["  ", "self-attention"])], "request_id int, current_section_id string, concepts array<string>")
    rows = fusion.memory_boost(hits, hints).orderBy("rank").collect()
    assert [r.pos for r in rows] == [1, 0] and abs(rows[0].score - (0.02 * 1.2 + 2)) < 1e-9


def test_weak_signal_leaves_the_vector_list(spark):
    lex = spark.createDataFrame([(1, 0, 0.1, 1, "bm25")], "request_id int, pos int, score double, rank int, source string")
    vec = spark.createDataFrame(
        [(1, 5, 0.9, 1, "vector", "text"), (1, 6, 0.8, 2, "vector", "fact")],
        "request_id int, pos int, score double, rank int, source string, content_type string",
    )
    req = spark.createDataFrame([(1, 5)], "request_id int, k int")
    rows = fusion.hybrid(lex, vec, req).orderBy("rank").collect()
    assert [(r.pos, r.source) for r in rows] == [(6, "vector"), (5, "vector")]


def test_scope_without_tokens_scores_zero(spark):
    chunks = spark.createDataFrame([("d", 0, "--"), ("d", 1, "..")], "scope_id string, pos long, search_text string")
    req = spark.createDataFrame([("r", "d", "word", 5)], "request_id string, scope_id string, query string, k int")
    rows = lexical.search(chunks, req, section_boost=False).orderBy("rank").collect()
    assert [(r.pos, r.score) for r in rows] == [(0, 0.0), (1, 0.0)]


def test_cap_uses_chunk_id_without_document(spark):
    hits = spark.createDataFrame(
        [(1, "", f"doc_{i}", 1.0, i + 1) for i in range(5)], "request_id int, doc_id string, chunk_id string, score double, rank int"
    )
    assert rerank.diversity_cap(hits).count() == 3


def test_budget(spark):
    df = spark.createDataFrame([("concept", 2, "q"), ("figure", 1, "q"), ("formula", 2, "q"), ("figure", 9, " ")], "i string, r int, q string")
    got = [r[0] for r in df.select(T.slide_budget(F.col("i"), F.col("r"), F.col("q"))).collect()]
    assert got == [1, 0, 0, 1]
