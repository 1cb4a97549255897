import random
from bisect import bisect_right
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lectern.llm import sharding

SF = "/root/testdata/sf0.001"


def brute(spark, docs, shards, slack=0.0, replicas=sharding.REPLICAS):
    """Every row goes round the ring by itself."""
    rows = docs.select("doc_id", sharding.place("text").alias("p"), F.crc32(F.coalesce("text", F.lit(""))).alias("c"), F.octet_length("text").alias("n")).collect()
    rows = sorted(((r.p, (r.doc_id is not None, r.doc_id or 0), (r.n or 0) + 16, r.c) for r in rows))
    arcs = sharding.ring(spark, shards, replicas).orderBy("lo").collect()
    assert arcs[0].lo == 0 and arcs[-1].hi == sharding.RING and all(a.hi == b.lo for a, b in zip(arcs, arcs[1:]))
    starts = [a.lo for a in arcs]
    room = {r.shard: r.room for r in sharding.capacities(spark, len(rows), shards, slack).collect()}
    waiting = [(i, bisect_right(starts, r[0]) - 1) for i, r in enumerate(rows)]
    home = [arcs[a].shard for _, a in waiting]
    at = {}
    while waiting:
        free, again = dict(room), []
        for i, a in waiting:
            while not free[arcs[a].shard]:
                a = (a + 1) % len(arcs)
            shard = arcs[a].shard
            if room[shard]:
                room[shard] -= 1
                at[i] = shard
            else:
                again.append((i, a))
        waiting = again
    slots, out = Counter(), []
    for i, (_, doc, size, crc) in enumerate(rows):
        out.append((doc, size, crc, at[i], slots[at[i]], home[i]))
        slots[at[i]] += 1
    return sorted(out)


def run(docs, shards, slack=0.0, replicas=sharding.REPLICAS):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r["size"], r.text_crc32, r.shard, r.slot, r.home) for r in sharding.shard(docs, shards, slack, replicas).collect())


def test_like_rows_that_walk_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for shards, slack, replicas in ((40, 0.0, 64), (7, 0.0, 3), (5, 0.1, 8)):
        got = run(docs, shards, slack, replicas)
        assert got == brute(spark, docs, shards, slack, replicas)
        loads = Counter(r[3] for r in got)
        if not slack:
            assert max(loads.values()) - min(loads[s] for s in range(shards)) <= 1
        for s in loads:
            assert sorted(r[4] for r in got if r[3] == s) == list(range(loads[s]))


def test_hot_text_spreads_and_stays_together(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.floor(F.col("id") / 5))).alias("text"))
    got = sharding.shard(docs, 40).join(docs, "doc_id").collect()
    assert set(Counter(r.shard for r in got).values()) == {75}
    on = defaultdict(set)
    for r in got:
        on[r.text].add(r.shard)
    copies = on.pop("the same text")
    assert 14 <= len(copies) <= 40
    assert sum(len(s) == 1 for s in on.values()) >= 0.8 * len(on)


def test_few_rows_move_when_a_shard_is_added(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, str(rng.random())) for i in range(4000)], "doc_id long, text string")
    before, after = ({r.doc_id: r.shard for r in sharding.shard(docs, n, slack=0.25).collect()} for n in (10, 11))
    assert max(Counter(before.values()).values()) <= 500
    moved = sum(before[i] != after[i] for i in before)
    assert moved <= 0.25 * len(before)  # 1/11 belongs to the new shard


def test_hard_rows(spark, hard_docs):
    got = sharding.shard(hard_docs, 5)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "home"]
    assert run(hard_docs, 5) == brute(spark, hard_docs, 5)
    assert run(hard_docs, 40) == brute(spark, hard_docs, 40)
    assert sharding.shard(hard_docs.limit(0), 5).count() == 0
    nulls = spark.range(100).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert Counter(r[3] for r in run(nulls, 8)) == {s: 13 if s < 4 else 12 for s in range(8)}
