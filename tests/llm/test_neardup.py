import random
import re

import numpy as np
import pytest
from llm_helpers import same_rows
from pyspark.sql import functions as F

from lectern.llm import graph, neardup


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 85 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def chain(rng, n, start, length=90):
    """Copies that drift: each differs from the one before by a word or two."""
    words = [f"v{rng.randrange(10**6)}" for _ in range(length)]
    for i in range(n):
        yield start + i, " ".join(words)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(length)] = f"v{rng.randrange(10**6)}"


@pytest.mark.parametrize("block", [512, 16])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(7)
    rows = [*chain(rng, 150, 1000), *chain(rng, 40, 100, 12), *((i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(60))]
    rows += [(500 + i, rows[i % 150][1].upper()) for i in range(30)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def judged(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=str)


@pytest.mark.parametrize("turned", [False, True])
def test_one_id_on_several_texts(spark, turned):
    rng = random.Random(3)
    a, b, c = ([f"{t}{rng.randrange(10**6)}" for _ in range(300)] for t in "abc")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "more"])), (9, " ".join([*b, "more"])), (9, " ".join(c))]
    # an id on many texts, each with a copy under an id of its own, and one text many times
    many = [[f"m{i}x{rng.randrange(10**6)}" for _ in range(60)] for i in range(80)]
    rows += [(50, " ".join(m)) for m in many] + [(100 + i, " ".join([*m, "more"])) for i, m in enumerate(many)] + [(50, " ".join(many[0]))] * 40
    rows = rows[::-1] if turned else rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert judged(docs) == brute(rows)
    kept = sorted((r.doc_id, r.text) for r in neardup.keep_one(docs).collect())
    assert kept == sorted((d, t) for d, t in rows if d in (5, 50) or t == " ".join(c))


def test_pairs_within_the_threshold_share_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, neardup.SYMBOLS, dtype=np.uint16)
    for _ in range(300):
        other = base.copy()
        gone = rng.choice(neardup.SYMBOLS, neardup.FAR, replace=False)
        other[gone] ^= 1
        keys = neardup.index_keys(np.stack([base, other]))
        assert set(keys[0]) & set(keys[1])


def test_signatures_of_links_are_near():
    rng, known = random.Random(2), {}
    far = []
    for _ in range(200):
        words = [f"u{rng.randrange(10**6)}" for _ in range(400)]
        other = words.copy()
        for i in rng.sample(range(0, 400, 6), 6):
            other[i] = "changed"
        a, b = (neardup.shingles(" ".join(w), known) for w in (words, other))
        x, y = (np.frombuffer(neardup.signature(s), dtype=np.uint16) for s in (a, b))
        far.append((x != y).sum())
    assert max(far) <= neardup.FAR


def test_hard_rows(spark, hard_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(hard_docs).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    assert [g[:3] for g in got] == brute(rows)
    assert all(k == (d is None or d == c) for d, _, c, k in got)
    kept = neardup.keep_one(hard_docs)
    same_rows(kept, hard_docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d != 8), key=str)
    assert neardup.near_duplicates(hard_docs.limit(0)).count() == 0
    assert neardup.keep_one(hard_docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3), (300, 101), (300, 250)]
    rng = random.Random(0)
    rng.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 300: 100, 250: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long").select("a", F.col("b"))).count() == 0
