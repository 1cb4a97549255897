import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


def water(sizes, weights, most=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = most * sizes[s]
        rest -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {None: rng.randint(0, 50), **{f"s{i}": rng.choice([0, 1, 10, 1000, rng.randint(0, 10**6)]) for i in range(rng.randint(1, 30))}}
    sized = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    want = water(sizes, mixing.WEIGHTS)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def test_rounding_keeps_targets_and_agrees(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice("aaaabbc")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert {k: r.taken for k, r in got.items()} == again
    assert len(got) == 3000 and all(r.size == len(rows[k][1].split()) and r.taken == r.copies * r.size <= 3 * r.size for k, r in got.items())
    for source in "abc":
        own = [r for r in got.values() if r.source == source]
        rate = own[0].target / own[0].source_size
        assert all(r.copies in (int(rate), int(rate) + 1) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


def test_expected_copies_hold(spark):
    """Over many ids the share of documents rounded up is the fraction, for small and large ones alike."""
    rows = [(i, "w " * (1 + 30 * (i % 2)), "s" if i % 4 < 2 else "t") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source", "size").agg(F.avg("copies").alias("c"), F.first("target").alias("t"), F.first("source_size").alias("n")).collect()
    for r in got:
        assert r.c == pytest.approx(r.t / r.n, abs=0.06)


def test_hard_rows_and_empty_tables(spark, hard_docs):
    got = mixing.mix(hard_docs)
    assert got.count() == hard_docs.count()
    rows = got.collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(hard_docs.limit(0)).count() == 0


def test_rows_of_one_id_spread_over_blocks(spark):
    """Without ids, or with one on all rows: bounded blocks, targets met, and reruns agree."""
    rng = random.Random(5)
    rows = [(None if i % 2 else 7, "w " * rng.randint(1, 9), "a" if i % 3 else "b") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = lambda df: sorted((str(r.doc_id), r.source, r.size, r.taken) for r in df.collect())
    mixed = mixing.mix(docs)
    assert counted(mixed) == counted(mixing.mix(docs.repartition(5)))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
    open_docs = docs.select("source", F.monotonically_increasing_id().alias("row"), "doc_id", F.lit(3).cast("long").alias("size"), F.lit(0.5).alias("p"))
    blocks = spark.createDataFrame([("a", 63), ("b", 32)], "_source string, m long")
    sizes = [r.n for r in mixing.round_level(open_docs, blocks, 0).select((F.size("done") + 1).alias("n")).collect()]
    assert sum(sizes) == 6000 and len(sizes) == 95 and max(sizes) <= 2 * mixing.BLOCK
