"""Benchmark decontamination: a hash set of test n-grams probed by every token window.

Windows of the benchmark (``width`` consecutive words; a shorter item is one window) are a
small table. Each document is scanned once: its words become an array, every window of the
array is hashed inside the row, the hashes are unnested and probe the broadcast windows,
and a hash hit counts only where the words themselves agree. Only hits and one marker row
per document leave the scan, so the shuffle carries no text.

The windows are counted first. Above ``BROADCAST_BYTES`` they are not broadcast: hashes
meet them in a shuffle join and the words are compared afterwards, document by document.

Defined results: a null or empty text has no words and is clean; items without words have
no windows; an item id of null is no item; repeated rows each come back; rows that share a
doc_id but not the text are judged apart; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.columns import LETTER_WORD, letter_words, once
from lectern.operators.stage import written

WIDTH = 13
#: Contaminated: at least this share of the words is hit.
SHARE = 20
#: Estimated size up to which benchmark windows are broadcast.
BROADCAST_BYTES = 64 << 20
#: Keys of contaminated rows up to which they are broadcast: 32 bytes each.
BROADCAST_ROWS = 1_000_000


@dataclass
class Windows:
    """``rows`` (hash, gram, items), the lengths that occur, and whether broadcast is safe."""

    rows: DataFrame
    lengths: list[int]
    small: bool


def windows(items: DataFrame, width: int = WIDTH) -> Windows:
    """Distinct word windows of ``items`` (item_id, text) with the items each occurs in."""
    worded = items.select(F.col("item_id").cast("string").alias("item"), letter_words(F.col("text")).alias("w"))
    worded = worded.where(F.col("item").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    grams = worded.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), width).alias("gram"))
    rows = written(
        grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("hash", F.xxhash64("gram")),
        "windows",
    )
    # at most `width` lengths, one row each
    sizes = rows.groupBy(F.size("gram").alias("n")).agg(F.sum(F.lit(100) + F.octet_length(F.array_join("gram", " ")) + 24 * F.size("items")).alias("bytes")).collect()
    return Windows(rows, sorted(r["n"] for r in sizes), sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES)


def _hashes(words: Column, lengths: list[int]) -> Column:
    """A marker (null), then for each length the hash of the window at each position.

    Near the end windows are shorter than asked for; as true word runs they can only hit a
    window of their own length.
    """
    one = lambda n: F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.xxhash64(F.slice(words, i, n)))
    marker = F.array(F.lit(None).cast("long"))
    return F.when(F.size(words) == 0, marker).otherwise(F.concat(marker, *[one(n) for n in lengths]))


def hits(docs: DataFrame, found: Windows) -> DataFrame:
    """(doc_id, text_key, n_words, at, len, items): one marker row per document row, ``at`` null,
    and a row for each verified window, ``at`` its first word counted from 0."""
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        once(letter_words(F.col("text")), lambda w: F.struct(w.alias("words"), _hashes(w, found.lengths).alias("hashes"))).alias("d"),
    )
    rows = rows.select("doc_id", "text_key", F.col("d.words").alias("words"), F.size("d.words").alias("n_words"), F.posexplode("d.hashes").alias("k", "probe"))
    at = F.when(F.col("k") > 0, (F.col("k") - 1) % F.col("n_words"))
    same = lambda words, at: ~(F.slice(words, at + 1, F.size("gram")) != F.col("gram"))
    if found.small:
        joined = rows.join(F.broadcast(found.rows), (F.col("probe") == F.col("hash")) & same(F.col("words"), (F.col("k") - 1) % F.col("n_words")), "left")
        return joined.where((F.col("k") == 0) | F.col("hash").isNotNull()).select(
            "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), at.alias("at"), F.size("gram").alias("len"), "items"
        )
    bare = rows.select("doc_id", "text_key", "n_words", "k", "probe")
    marks = bare.where("k = 0").select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    maybe = bare.where("k > 0").join(found.rows, F.col("probe") == F.col("hash")).select("doc_id", "text_key", "n_words", at.alias("at"), "gram", "items")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), letter_words(F.col("text")).alias("words")).dropDuplicates(["d", "t"])
    sure = maybe.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).where(same(F.col("words"), F.col("at")))
    return marks.unionByName(sure.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "at", F.size("gram").alias("len"), "items"))


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted spans (at, len)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"]).cast("long")


def judge(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, item_ids, spans, contaminated."""
    found = hits(docs, windows(items, width))
    per = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.when(F.col("at").isNull(), 1).otherwise(0)).alias("times"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    judged = per.select("doc_id", "text_key", "n_words", "spans", "item_ids", _covered(F.col("spans")).alias("n_hit"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return judged.select(
        "doc_id",
        "text_key",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        "spans",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _of(docs: DataFrame, found: DataFrame):
    return docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_t"])


def drop_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``docs`` without the contaminated rows, columns as they are.

    The rows to drop are written and counted first: up to ``BROADCAST_ROWS`` of them no text is
    shuffled to find them.
    """
    bad = judge(docs, items, width, share).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct()
    bad = written(bad, "contaminated")
    small = F.broadcast if bad.count() <= BROADCAST_ROWS else (lambda df: df)
    return docs.join(small(bad), _of(docs, bad), "left_anti")


def drop_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with every hit word removed from the text, the rest of the text untouched."""
    found = judge(docs, items, width).where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("spans").alias("_s")).dropDuplicates(["_d", "_t"])
    joined = docs.join(found, _of(docs, found), "left")
    text, hit = docs["text"], found["_s"]
    cased = LETTER_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(f"{cased}|{gap}"), F.lit(0))
    first_is_gap = text.rlike(f"^{gap}").cast("int")  # words and gaps take turns

    def keep(piece: Column, i: Column) -> Column:
        word = (i - first_is_gap).cast("int")
        inside = F.exists(hit, lambda s: (F.floor(word / 2) >= s["at"]) & (F.floor(word / 2) < s["at"] + s["len"]))
        return (word % 2 != 0) | ~inside

    cleaned = F.array_join(F.filter(pieces, keep), "")
    text = F.when(hit.isNull(), text).otherwise(cleaned).alias("text")
    return joined.select(*(text if c == "text" else docs[c] for c in docs.columns))
