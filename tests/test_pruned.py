"""The pruned lexical search gives the rows of the plain one and reads fewer postings."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical

WORDS = [f"common{i}" for i in range(8)] + [f"rare{i}" for i in range(300)]


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(4)
    rows = []
    for pos in range(1500):
        words = rng.choices(WORDS[:8], k=rng.randint(3, 40)) + rng.sample(WORDS[8:], rng.randint(0, 4))
        rows.append(("all" if pos % 10 else "few", pos, "s%d" % (pos % 3), "# head\n" * (pos % 2) + " ".join(words), pos % 4 == 0, pos % 5 == 0))
    chunks = spark.createDataFrame(rows, "scope_id string, pos long, section_id string, search_text string, is_slide boolean, has_formula boolean")
    chunks = chunks.withColumn("text", F.col("search_text")).cache()
    asked = [(f"r{i}", "all" if i % 4 else "few", " ".join(rng.sample(WORDS[:8], 3) + rng.sample(WORDS[8:], i % 4)), 1 + i % 5, "s1" if i % 3 else "") for i in range(24)]
    asked += [("none", "all", "unheard of", 3, ""), ("blank", "few", "", 2, "s1")]
    return chunks, spark.createDataFrame(asked, "request_id string, scope_id string, query string, k int, section_id string")


def rows(df):
    return sorted((r.request_id, r["rank"], r.pos, round(r.score, 6), r.n_matched) for r in df.collect())


@pytest.mark.parametrize("slides, boost, width", [(False, False, 1024), (False, True, 64), (True, True, 200)])
def test_same_rows(library, slides, boost, width):
    chunks, asked = library
    plain = lexical.search(chunks, asked, slides=slides, section_boost=boost)
    pruned = lexical.search(chunks, asked, slides=slides, section_boost=boost, width=width)
    assert rows(plain) == rows(pruned)


def test_common_words_are_left_alone(library):
    chunks, asked = library
    report = lexical.pruned_search(chunks, asked.where("scope_id = 'all' and query like '%rare%'"), width=1024).report.collect()
    assert len(report) > 5 and all(r.blocks_read <= r.n_blocks for r in report)
    assert sum(r.postings_read for r in report) < 0.5 * sum(r.n_postings for r in report)
