"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``rate = target / size of the source`` times. The whole
part is given; the fractions are rounded dependently: two documents meet, words move at
random from one to the other until the copies of one are whole, and the other goes on to
the next meeting. Words are what moves, so the words of a source stay exactly at its target
until one last document, without partner, is rounded to the nearer whole. Each move is a
fair game, so every document keeps its expected number of copies.

The meetings form a reduction tree: a source is dealt by hash into blocks of about
``BLOCK`` documents, one fold settles a block but for one document, and those residuals are
blocks again one level up. A source with a third of all rows has more blocks, no larger
ones. All randomness is hashes of the level and of a row's number in the order of source, doc_id and
size, so reruns agree, and rows without an id or with one and the same spread like all others.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source,
last in order; sources of size 0 have target 0; repeated rows are documents of their own;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.columns import SPACED_WORD
from lectern.llm.order import numbered
from lectern.operators.stage import written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 64
#: Sources up to which their table is broadcast (some 100 bytes a source).
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, size): the sums are shared by weight, no
    target above ``most`` sizes, the excess shared again.

    The level at which all is shared follows from sources in order of cap per weight: with the
    first k at their cap, the rest get ``(total - caps) / weights of the rest`` per weight; the
    first k whose level the next source can hold is the answer. One row per source, after
    map-side sums, passes these two windows; documents never do.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("level", (total - before) / rest)
    holds = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.row_number().over(by_ratio).alias("k"), "level"))
    per = per.withColumn("holds", holds)
    per = per.withColumn("level", F.min("holds").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return per.select("source", "source_size", "n", target.alias("target"))


def _uniform(*values: Column) -> Column:
    return (F.xxhash64(*values).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


DOC = "struct<row:bigint,doc_id:{id},size:bigint,p:double>"


def _meet(acc: Column, x: Column, level: int, kind: str) -> Column:
    """Words move between the open document ``acc.open`` and ``x`` until one is whole."""
    c = acc["open"]
    gain = F.least(c["size"] * (1 - c["p"]), x["size"] * x["p"])  # the open one gains, x loses
    lose = F.least(x["size"] * (1 - x["p"]), c["size"] * c["p"])
    up = F.coalesce(_uniform(c["row"], x["row"], F.lit(level)) * (gain + lose) < lose, F.lit(False)) | (gain + lose <= 0)
    move = F.when(up, gain).otherwise(-lose)
    done_is_c = F.when(up, c["size"] * (1 - c["p"]) <= x["size"] * x["p"]).otherwise(c["size"] * c["p"] <= x["size"] * (1 - x["p"]))
    clamp = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    pair = lambda d, p: F.struct(d["row"].alias("row"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), p.cast("double").alias("p"))
    c_p, x_p = clamp(c["p"] + move / c["size"]), clamp(x["p"] - move / x["size"])
    settled = F.when(done_is_c, pair(c, F.when(up, 1.0).otherwise(0.0))).otherwise(pair(x, F.when(up, 0.0).otherwise(1.0)))
    going = F.when(done_is_c, pair(x, x_p)).otherwise(pair(c, c_p))
    return F.when(c.isNull(), F.struct(pair(x, x["p"]).cast(kind).alias("open"), acc["done"].alias("done"))).otherwise(
        F.struct(going.cast(kind).alias("open"), F.concat(acc["done"], F.array(settled.cast(kind))).alias("done"))
    )


def round_level(open_docs: DataFrame, blocks: DataFrame, level: int) -> DataFrame:
    """One level of the tree: (source, block, done, open) from (source, row, doc_id, size, p) and
    ``blocks`` (_source, m), the number of blocks a source has at this level."""
    id_type = open_docs.schema["doc_id"].dataType.simpleString()
    kind = DOC.format(id=id_type)
    dealt = open_docs.join(blocks, F.col("source").eqNullSafe(F.col("_source")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.col("m")))
    # the largest meet first: a small document is settled at once, a large one stays open until it is filled
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64("row", F.lit(-1 - level)).alias("h"), "row", "doc_id", "size", "p")
    per = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    return per.select("source", "block", F.aggregate("items", start, lambda acc, x: _meet(acc, x, level, kind)).alias("r")).select("source", "block", "r.done", "r.open")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document row."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sized = numbered(sized, ["source", "doc_id", "size"], "numbered-sizes").withColumnRenamed("rank", "row")
    per = written(targets(sized, weights, most), "targets")
    counted = per.agg(F.count("*").alias("sources"), F.max("n").alias("largest")).first()
    small = F.broadcast if counted["sources"] <= BROADCAST_SOURCES else (lambda df: df)
    facts = per.withColumnRenamed("source", "_source")
    rated = sized.join(small(facts), sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rated = rated.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
    given = ["doc_id", "source", "size", "source_size", "target", "whole"]
    settled = [rated.where("size = 0 or p = 0").select(*given, F.lit(0.0).alias("p"))]
    open_docs = rated.where("size > 0 and p > 0").select("source", "row", "doc_id", "size", "p")
    m, level = F.ceil(F.col("n") / BLOCK), 0
    blocks, most_blocks = per.select(F.col("source").alias("_source"), m.alias("m")), -(-(counted["largest"] or 0) // BLOCK)
    done = []
    while True:
        tree = written(round_level(open_docs, small(blocks), level), f"tree{level}")
        done.append(tree.select("source", F.explode("done").alias("d")))
        open_docs = tree.select("source", "open.row", "open.doc_id", "open.size", "open.p")
        if most_blocks <= 1:
            break
        blocks = blocks.select("_source", F.ceil(F.col("m") / BLOCK).alias("m"))
        most_blocks, level = -(-most_blocks // BLOCK), level + 1
    last = open_docs.drop("row").withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    rounded = reduce(DataFrame.unionByName, [last, *(d.select("source", "d.doc_id", "d.size", "d.p") for d in done)])
    facts = facts.select("_source", "source_size", "target", F.floor(F.col("target") / F.col("source_size")).alias("whole"))
    settled.append(rounded.join(small(facts), rounded["source"].eqNullSafe(F.col("_source"))).select(*given, "p"))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return reduce(DataFrame.unionByName, settled).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
