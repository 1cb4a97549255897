"""Near-duplicates by MinHash and a multi-index Hamming join, confirmed on full sets.

1. *Sketch.* One pass makes of each text its set of word shingles, a digest of that set and a
   signature of ``SYMBOLS`` b-bit minima. Equal sets become one class at once.
2. *Multi-index join.* A signature is split into ``CHUNKS`` chunks. Where two signatures differ
   in at most ``FAR = 2 * CHUNKS - 1`` symbols, some chunk differs in at most one. Each chunk is
   therefore indexed under its deletion variants, one symbol left out each time, so all pairs
   within ``FAR`` share a key. A link at the least similarity is further apart than ``FAR``
   with a chance of 2.3 in a million (binomial tail: 60 symbols, each other with 0.15).
3. *Clusters, not pairs.* Of a key only its smallest member, largest member and size are
   aggregated (map-side); members hang on the smallest. Components of those stars are clusters
   that no link leaves. A bucket of n members gives n edges, never n^2.
4. *Blocks.* The members of a cluster, in order of signature, fall into blocks of ``BLOCK``. A task
   takes one block: pairs within ``FAR``, nearest first, are confirmed on their full sets while
   they are still in different components. If a cluster has more blocks, pairs of blocks
   follow, but only where they are not yet one component. A task holds two blocks at most and
   returns a row for each document or union, so chains of thousands of copies stay linear.

Defined results: null, empty and blank texts have no shingles and stay alone; texts of fewer
words than a shingle are one shingle; a null doc_id is in no one's reach, stays alone and is
kept; repeated rows each come back, with one component; extra columns are ignored. A doc_id on
rows with different texts names several documents: each text has its own links, and the smallest
doc_id among the rows it reaches. Classes therefore have numbers of their own, and a class's text
is found again by doc_id and a hash of the text, so an id on many texts stays a narrow key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lectern.llm.graph import components
from lectern.operators.stage import written

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK
FAR = 2 * CHUNKS - 1
BLOCK = 512
#: Rows of (id, cluster) up to which they are broadcast: 32 bytes each.
BROADCAST_ROWS = 1_000_000
REMEMBER = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
MASKS = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)[:, None]
FACTORS = (_rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


# --- one text ----------------------------------------------------------------------------


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. ``known`` remembers word hashes between texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > REMEMBER:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : len(words) - size + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> bytes:
    """``SYMBOLS`` minima of 16 bits each."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(least, ((found[i : i + 4096][None, :] ^ MASKS) * FACTORS).min(axis=1), out=least)
    return ((least * MIX) >> np.uint64(48)).astype(np.uint16).tobytes()


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[bytes, int] = {}
    for batch in batches:
        rows = []
        for text in batch["text"]:
            found = shingles(text, known)
            rows.append((len(found), _digest(found), signature(found)) if len(found) else (0, None, None))
        yield pd.DataFrame(
            {"doc_id": batch["doc_id"], "print": batch["print"], "n_shingles": [r[0] for r in rows], "digest": [r[1] for r in rows], "sig": [r[2] for r in rows]}
        )


# --- multi-index join --------------------------------------------------------------------


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """(documents, keys): for each chunk its deletion variants, hashed with chunk and place."""
    parts = symbols.reshape(len(symbols), CHUNKS, CHUNK).astype(np.uint64)
    keys = []
    for gone in range(CHUNK):
        h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64) + np.uint64(gone), parts.shape[:2])
        for i in range(CHUNK):
            if i != gone:
                h = (h ^ parts[:, :, i]) * MIX
                h = h ^ (h >> np.uint64(31))
        keys.append(h)
    return np.stack(keys, axis=2).reshape(len(symbols), -1)


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch.iloc[i : i + 2000]
            symbols = np.frombuffer(b"".join(part["sig"]), dtype=np.uint16).reshape(len(part), SYMBOLS)
            keys = index_keys(symbols).astype(np.int64)
            yield pd.DataFrame({"key": keys.ravel(), "cls": np.repeat(part["cls"].to_numpy(), keys.shape[1])})


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) over classes whose components hold every pair within ``FAR``."""
    keys = classes.select("cls", "sig").mapInPandas(_index, "key long, cls long")
    buckets = keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    buckets = written(buckets, "buckets")
    pairs = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    large = buckets.where("n > 2").select("key", "lo")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    stars = keys.join(large, "key").where("cls > lo").select(F.col("lo").alias("a"), F.col("cls").alias("b"))
    return written(pairs.unionByName(stars).distinct(), "candidates")


# --- blocks ------------------------------------------------------------------------------


def _deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the blocks of the clusters of one sorted partition."""
    cluster, n = None, 0
    for batch in batches:
        blocks = np.empty(len(batch), dtype=np.int64)
        own = batch["cluster"].to_numpy()
        for i, c in enumerate(own):
            cluster, n = (c, n + 1) if c == cluster else (c, 0)
            blocks[i] = n // BLOCK
        yield batch.drop(columns="part").assign(block=batch["part"].to_numpy() * (1 << 32) + blocks)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of the classes, each once a partition; what only shares id and hash with a class goes."""
    known: dict[bytes, int] = {}
    done: set[int] = set()
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            if row.cls in done:
                continue
            found = shingles(row.text, known)
            if _digest(found) == row.digest:
                done.add(row.cls)
                rows.append((row.cluster, row.block, row.cls, found.tobytes(), signature(found)))
        yield pd.DataFrame(rows, columns=["cluster", "block", "cls", "shingles", "sig"])


class Unions:
    def __init__(self, labels: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def link(rows: pd.DataFrame, unions: Unions, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Confirm pairs (i, j), i in ``left``, j in ``right``, until no pair within ``FAR`` is left in two components."""
    sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
    sizes = np.array([len(s) for s in sets])
    symbols = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint16).reshape(len(rows), SYMBOLS)
    pairs = []
    for i in left:
        others = right[right > i] if left is right else right
        far = (symbols[others] != symbols[i]).sum(axis=1)
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        ok = (far <= FAR) & (100 * small >= PERCENT * large)
        pairs.append(np.stack([far[ok], np.full(ok.sum(), i), others[ok]], axis=1))
    found = np.concatenate(pairs) if pairs else np.zeros((0, 3), dtype=np.int64)
    done = []
    for _, i, j in found[np.argsort(found[:, 0], kind="stable")].tolist():
        if unions.root(i) == unions.root(j):
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= PERCENT * (len(sets[i]) + len(sets[j]) - common):
            unions.join(i, j)
            done.append((i, j))
    return done


def _link_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cls", kind="stable").drop_duplicates("cls").reset_index(drop=True)
    unions, every = Unions(rows["cls"].tolist()), np.arange(len(rows))
    link(rows, unions, every, every)
    names = rows["cls"].to_numpy()
    return pd.DataFrame({"cluster": rows["cluster"], "block": rows["block"], "cls": names, "label": names[[unions.root(i) for i in range(len(rows))]]})


def _link_cell(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["label", "cls"], kind="stable").reset_index(drop=True)
    unions = Unions(rows["label"].tolist())
    left = np.flatnonzero(rows["block"] == rows["b1"])
    right = np.flatnonzero(rows["block"] == rows["b2"])
    labels = rows["label"].to_numpy()
    done = link(rows, unions, left, right)
    return pd.DataFrame({"a": [labels[i] for i, _ in done], "b": [labels[j] for _, j in done]}, dtype="int64")


def _across_blocks(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between labels of different blocks of a cluster."""
    blocks = labels.groupBy("cluster", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    one = blocks.select("cluster", F.col("block").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = blocks.select("cluster", F.col("block").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    cells = one.join(two, "cluster").where("b1 < b2 and not (lo1 = hi2 and hi1 = lo2 and lo1 = hi1)").select("cluster", "b1", "b2")
    ends = cells.select("cluster", "b1", "b2", F.explode(F.array("b1", "b2")).alias("block"))
    members = sets.join(labels.select("cls", "label"), "cls").join(ends, ["cluster", "block"])
    return members.groupBy("cluster", "b1", "b2").applyInPandas(_link_cell, "a long, b long")


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, print, n_shingles, component), one row per row of ``docs``; ``print`` is the hash of its text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    sketches = written(plain.mapInPandas(_sketch, "doc_id long, print long, n_shingles long, digest binary, sig binary"), "sketches")
    named = sketches.where("digest is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "print")).alias("first")
    classes = named.groupBy("digest").agg(first, F.min("sig").alias("sig"), F.count("*").alias("n"))
    # the numbers are written with their rows: whatever runs later reads the same ones
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "first.doc_id", "first.print", "sig", "n"), "classes")
    clusters = components(candidate_edges(classes)).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    ordered = classes.join(clusters, "cls").repartitionByRange("cluster", "sig", "cls").sortWithinPartitions("cluster", "sig", "cls")
    dealt = ordered.select("cluster", "cls", "doc_id", "print", "digest", F.spark_partition_id().cast("long").alias("part"))
    dealt = written(dealt.mapInPandas(_deal, "cluster long, block long, cls long, doc_id long, print long, digest binary"), "blocks")
    small = F.broadcast if dealt.count() <= BROADCAST_ROWS else (lambda df: df)
    texts = plain.join(small(dealt), ["doc_id", "print"]).select("cluster", "block", "cls", "digest", "text")
    sets = written(texts.mapInPandas(_sets, "cluster long, block long, cls long, shingles binary, sig binary"), "sets")
    labels = written(sets.groupBy("cluster", "block").applyInPandas(_link_block, "cluster long, block long, cls long, label long"), "linked")
    across = written(_across_blocks(sets, labels), "across")
    joined = components(across).select(F.col("node").alias("label"), F.col("component").alias("united"))
    final = labels.join(joined, "label", "left").select("cls", F.coalesce("united", "label").alias("united"))
    linked = written(classes.join(final, "cls").select("cls", "united", "doc_id"), "united")
    least = linked.groupBy("united").agg(F.min("doc_id").alias("least"))
    reach = linked.join(least, "united").select("cls", "least")
    found = classes.join(reach, "cls", "left").where("n > 1 or least <> doc_id").select("digest", F.coalesce("least", "doc_id").alias("component"))
    return sketches.join(found, "digest", "left").select(
        "doc_id", "print", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType
    return _judged(docs).select(
        F.col("doc_id").cast(id_type).alias("doc_id"),
        "n_shingles",
        F.col("component").cast(id_type).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component"))).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that have a smaller doc_id in their group; columns as they are.

    The texts to drop are joined, not those to keep: they are the smaller side, and the documents
    are shuffled only if even those are too many to broadcast. A text is named by doc_id and
    hash, so a document is not dropped for another one of its id.
    """
    drop = _judged(docs).where("doc_id <> component").select(F.col("doc_id").alias("_drop"), F.col("print").alias("_print")).distinct()
    drop = written(drop, "copies")
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    return docs.join(drop, (docs["doc_id"] == drop["_drop"]) & (F.xxhash64(docs["text"]) == drop["_print"]), "left_anti")
