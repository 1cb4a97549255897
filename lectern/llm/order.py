"""Dense numbers in a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lectern.operators.stage import written

#: Bits of a monotonically increasing id that number the rows of a partition.
ROW_BITS = 33


def numbered(df: DataFrame, keys: list, label: str) -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2, ... in the order of ``keys`` over all rows.

    Rows are dealt by range and sorted where they lie; a row's number is its place in its
    partition plus the rows of the partitions before it. Equal keys are dealt out by the
    place of the row in the input as well, so that a group of equal rows of any size is
    spread. The result is written once; what is joined to it is one number a partition.
    """
    tied = df.withColumn("_row", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    stored = written(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", ROW_BITS)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = stored.join(F.broadcast(offsets), part == F.col("_part"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.withColumn("rank", rank).drop("_at", "_part", "_before")
