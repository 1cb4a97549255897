"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``REPLICAS`` places of a ring; a row belongs to the first of them at or after
its own place. No shard takes more than its capacity: rows that do not fit continue
clockwise to the next place of a shard with room. With ``slack`` 0 the capacities add up to the
number of rows, so shards differ by one row at most; with more slack fewer rows move
when a shard is added or removed.

A row's place is the hash of its text, so rows with equal texts stay together as far as
capacities let them, and a group that is larger than a shard goes on to the shards that
follow. Equal places are ordered by doc_id.

*How it is distributed.* The rows are numbered along the ring by one range sort of narrow rows, which
splits groups of equal texts too. What then moves round the ring is runs of numbers (from,
to), not rows: at first one run an arc. In each round the shards take runs in ring order until
they are full and cut the run that crosses their limit; the rest moves on. A round fills a shard or
is the last one, so tables of at most places + shards x rounds runs are all that is
rewritten. In the end each row finds its run by a join on blocks of numbers.

Defined results: null texts weigh ``OVERHEAD`` bytes and share a place; null and repeated
doc_ids are rows like others; equal rows get slots of their own; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.llm.order import numbered
from lectern.operators.stage import written

REPLICAS = 64
#: Bytes a row weighs beside its text.
OVERHEAD = 16
#: Places on the ring: 0 to 2^62 - 1.
RING = 1 << 62
#: What is added to the number of an arc on the second lap; no ring has so many arcs.
LAP = 1 << 40
#: Shares of an interval that an average one covers, when intervals are found by a join.
FINE = 4


def place(*values: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 2)


def ring(spark: SparkSession, shards: int, replicas: int = REPLICAS) -> DataFrame:
    """(arc, shard, lo, hi): the places lo <= p < hi whose rows belong to ``shard``, in ring order.
    What lies behind the last point belongs to the first one."""
    points = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    points = points.select("shard", place(F.lit("shard"), "shard", "replica").alias("at"))
    order = Window.orderBy("at", "shard")
    arcs = points.select("shard", F.coalesce(F.lag("at").over(order) + 1, F.lit(0)).alias("lo"), (F.col("at") + 1).alias("hi"))
    first = arcs.agg(F.min(F.struct("hi", "shard"))["shard"].alias("shard"), F.max("hi").alias("lo")).withColumn("hi", F.lit(RING))
    closed = arcs.unionByName(first).where("lo < hi")
    return closed.withColumn("arc", F.row_number().over(Window.orderBy("lo")).cast("long"))


def find(rows: DataFrame, value: str, intervals: DataFrame, span: int) -> DataFrame:
    """Each row with the interval (lo, hi, ...) its ``value`` lies in, as a hash join: both sides
    meet on blocks of ``span`` values. The intervals are a table of bounded size."""
    block = lambda v: v - v % span
    spread = intervals.withColumn("_block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1), F.lit(span))))
    inside = (block(F.col(value)) == F.col("_block")) & (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    return rows.join(F.broadcast(spread), inside).drop("_block", "lo", "hi")


def fill(runs: DataFrame, arcs: DataFrame, room: DataFrame) -> DataFrame:
    """(lo, hi, shard, round): which runs of numbers each shard takes.

    ``runs`` (lo, hi, arc) are the numbers of each arc, ``arcs`` (arc, shard), ``room`` (shard, room).
    """
    taken: list[DataFrame] = []
    free = room
    waiting = written(runs.where("lo < hi"), "waiting")
    while not waiting.isEmpty():
        stops = arcs.join(free.where("room > 0"), "shard").select("arc", F.struct("shard", "room").alias("to"))
        # the next arc with room: on this lap or, behind the last one, on the next
        laps = stops.unionByName(stops.withColumn("arc", F.col("arc") + LAP))
        around = Window.orderBy(F.col("arc").desc(), F.col("lo").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = laps.unionByName(waiting, allowMissingColumns=True).withColumn("to", F.last("to", ignorenulls=True).over(around))
        asked = met.where("lo is not null").select("lo", "hi", "arc", "to.shard", "to.room")
        ahead = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("shard").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
        left = F.greatest(F.col("room") - F.coalesce(ahead, F.lit(0)), F.lit(0))
        answered = written(asked.withColumn("cut", F.least(F.col("hi"), F.col("lo") + left)), "answered")
        taken.append(answered.where("cut > lo").select("lo", F.col("cut").alias("hi"), "shard", F.lit(len(taken)).alias("round")))
        used = reduce(DataFrame.unionByName, taken).groupBy("shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("used"))
        free = room.join(used, "shard", "left").select("shard", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
        waiting = answered.where("cut < hi").select(F.col("cut").alias("lo"), "hi", "arc")
    nothing = runs.where("false").select("lo", "hi", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("round"))
    return written(reduce(DataFrame.unionByName, taken, nothing), "runs")


def capacities(spark: SparkSession, rows: int, shards: int, slack: float) -> DataFrame:
    """(shard, room): with no slack ``rows`` are shared out to the last one."""
    if slack:
        return spark.range(shards).select(F.col("id").alias("shard"), F.lit(math.ceil((1 + slack) * rows / shards)).cast("long").alias("room"))
    return spark.range(shards).select(F.col("id").alias("shard"), (F.lit(rows // shards) + (F.col("id") < rows % shards).cast("long")).alias("room"))


def shard(docs: DataFrame, shards: int, slack: float = 0.0, replicas: int = REPLICAS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home), one row per row of ``docs`` (doc_id, text);
    ``home`` is the shard a row would be in without limits."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), place("text").alias("place"))
    arcs = written(ring(spark, shards, replicas), "arcs")
    placed = numbered(narrow, ["place", "doc_id", "size", "text_crc32"], "ring")
    at_home = find(placed, "place", arcs, RING // (FINE * shards * replicas))
    counted = at_home.groupBy("arc").agg(F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"))
    counted = written(counted, "home")
    rows = counted.agg(F.max("hi").alias("rows")).first()["rows"] or 0
    taken = fill(counted, arcs.select("arc", "shard"), capacities(spark, rows, shards, slack))
    before = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("shard").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    slots = taken.select("lo", "hi", "shard", (F.coalesce(before, F.lit(0)) - F.col("lo")).alias("_slot"))
    out = find(at_home.withColumnRenamed("shard", "home"), "rank", slots, max(1, rows // (FINE * shards * replicas)))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("_slot")).alias("slot"), "home")
