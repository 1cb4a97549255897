"""Scopes that are searched whole give the hits of the search term by term, and move each text once."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical

WORDS = "alpha beta gamma delta epsilon the of and rare".split()


@pytest.fixture(scope="module")
def chunks(spark):
    text = lambda d, i: " ".join(WORDS[(d * 7 + i * j) % 9] for j in range(1 + (d + i) % 6))
    rows = [(f"d{d}", i, f"s{i // 2}", None if (d, i) == (2, 1) else text(d, i), i % 2 == 0, i % 3 == 0) for d in range(12) for i in range(1 + d)]
    df = spark.createDataFrame(rows, "scope_id string, pos long, section_id string, text string, is_slide boolean, has_formula boolean")
    return df.withColumn("search_text", F.col("text")).cache()


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(f"r{d}{n}", f"d{d}", q, 1 + n * 2, "s1") for d in range(12) for n, q in enumerate(["the rare beta beta", "zzz", "alpha of"])]
    return spark.createDataFrame(rows, "request_id string, scope_id string, query string, k int, section_id string").cache()


def hits(chunks, requests, **how):
    found = lexical.search(chunks, requests, **how).select("request_id", "scope_id", "pos", "rank", "n_matched", F.round("score", 5))
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("how", [{"section_boost": False}, {}, {"slides": True}])
@pytest.mark.parametrize("bound", [15, 200_000])
def test_same_hits(monkeypatch, chunks, requests, how, bound):
    monkeypatch.setattr(lexical, "SCOPE_TOKENS", 0)
    want = hits(chunks, requests, **how)
    monkeypatch.setattr(lexical, "SCOPE_TOKENS", bound)
    assert hits(chunks, requests, **how) == want and len(want) > 50


def test_wording_that_matches_nothing_gets_its_shared_words(chunks, requests):
    asked = requests.where("k = 5").select(F.col("request_id").alias("query_id"), F.lit(0).alias("variant_no"), F.lit("the beta").alias("variant"), F.lit("zzz").alias("query"), "scope_id", "k", F.lit("").alias("section_id"))
    found = {(r.query_id, r.pos): r.score for r in lexical.search_variants(chunks, asked).collect()}
    texts = {(r.scope_id, r.pos): set((r.text or "").split()) for r in chunks.collect()}
    assert len(found) > 30 and all(s == len({"the", "beta"} & texts[("d" + q[1:-1], p)]) for (q, p), s in found.items())


def test_texts_are_dealt_out_once(chunks, requests):
    sizes = lexical.scope_sizes(chunks, requests)
    plan = lexical.whole_impacts(chunks, sizes.cache())._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1
