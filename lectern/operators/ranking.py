"""Top-k per group.

``row_number() <= k`` makes Catalyst plan a partial group limit below the shuffle:
every input partition keeps its own k best rows of a group, so a group that holds a
third of all rows sends only k rows per partition to the task that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int | str, name: str = "rank", most: int | None = None
) -> DataFrame:
    """Keep the first ``k`` rows of each group; ``k`` may be a column with a known maximum.

    With a per-row ``k`` the constant ``most`` (its maximum) still gives the planner a
    literal limit to push below the shuffle.
    """
    out = ranked(df, keys, order, name)
    if isinstance(k, int):
        return out.where(F.col(name) <= k)
    if most is not None:
        out = out.where(F.col(name) <= most)
    return out.where(F.col(name) <= F.col(k))


RUN = 8192


def running_before(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a group, ``order`` being whole numbers.

    Rows fall into runs of 8192 order numbers. A window inside each run and one over the
    runs' totals (combined map-side) give the same sums as one window over the group,
    without ever bringing a whole group into one task.
    """
    run = F.floor(F.col(order) / RUN)
    keyed = df.withColumn("_run", run)
    inside = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*keys, "_run").agg(F.sum(value).alias("_total"))
    starts = totals.select(*keys, "_run", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_start"))
    return (
        keyed.join(starts, [*keys, "_run"])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_run", "_start")
    )
