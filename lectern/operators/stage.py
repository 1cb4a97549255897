"""Written intermediate results.

A result that several later steps read is written once, as parquet, in the folder the
session names in ``spark.checkpoint.dir``. It survives lost executors, cuts the
lineage, and its true size drives the planner's later join choices. All of an application's
tables lie in one folder, ``lectern-<application id>``, to be dropped with it. Those that are written
inside ``passing`` go at its end, and the shuffle files of a write go with the write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.session import shared_dir


#: By this setting a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
#: Versions that do not know it keep them as before.
_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each ``passing`` that is open, the innermost last: the paths that go at its end.
_way: ContextVar[tuple[list[str], ...]] = ContextVar("way", default=())


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def joined_where_dealt(spark: SparkSession):
    """Tables written inside: a join takes rows as ``repartition`` has dealt them, if that was by some of its keys."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def put(df: DataFrame, path: str, mode: str) -> None:
    """Write parquet that takes little room and leaves no shuffle files behind."""
    with _setting(df.sparkSession, _FILES_GO, "true"):
        df.write.mode(mode).option("compression", "zstd").parquet(path)


def written(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """``df`` as a table of its own; a ``lasting`` one outlives the innermost ``passing`` it is written in."""
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/lectern-{application}/{label}-{uuid.uuid4().hex}"
    for paths in (_way.get()[:-1] if lasting else _way.get())[-1:]:
        paths.append(path)
    put(df, path, "errorifexists")
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end: nothing that is read later may come from them."""
    paths: list[str] = []
    token = _way.set((*_way.get(), paths))
    try:
        yield
    finally:
        _way.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives as a table of its own; tables written on the way to it go."""
    with passing(spark):
        return written(make(), label, lasting=True)


def nothing(spark: SparkSession, columns: str) -> DataFrame:
    """No rows of these columns (``name type, ...``), known to be none when a query is planned: joins with them fall away."""
    named = [c.split(" ", 1) for c in columns.split(", ")]
    return spark.range(1).where("false").select(*[F.lit(None).cast(kind).alias(name) for name, kind in named])


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once a row, whatever later steps ask of them.

    The optimizer moves a filter on a derived column below the projection that derives it and
    writes the whole expression out again, as often as the filter names it. The row of a
    generator is not taken apart like that.
    """
    made = df.withColumns(columns)
    rest = [c for c in made.columns if c not in columns]
    return made.select(*rest, F.inline_outer(F.array(F.struct(*columns))))
