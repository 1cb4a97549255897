"""Reflections: Markdown entries in a partitioned sink, one file for each entry.

An entry's folder is its day and title, so saving the same title again on that day replaces the entry, and no
other one is touched. Names are partition values: Spark escapes, lists and prunes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---- fixed values: the head of an entry and its file name ----
HEAD = ("---\ndate: ", "\ntags: [", "]\ntype: reflection\n---\n\n")
TAG_SEPARATOR = ", "
NAME_SEPARATOR, SUFFIX = "_", ".md"

SCHEMA = "value string, day string, title string"


def document(day: Column, tags: Column, content: Column) -> Column:
    """An entry as Markdown with its head; null tags and content count as empty."""
    listed = F.coalesce(F.array_join(tags, TAG_SEPARATOR), F.lit(""))
    return F.concat(F.lit(HEAD[0]), day, F.lit(HEAD[1]), listed, F.lit(HEAD[2]), F.coalesce(content, F.lit("")))


def save(entries: DataFrame, folder: str) -> None:
    """Write ``entries`` (day date, title, tags, content, saved: what orders them in time).

    Of entries of one day and title the last saved counts. Entries without a day are refused by the
    write; a null title counts as empty.
    """
    day = F.date_format("day", "yyyy-MM-dd")
    text = document(day, F.col("tags"), F.col("content"))
    named = entries.select(
        F.when(day.isNull(), F.raise_error(F.lit("a reflection needs a day"))).otherwise(day).alias("day"),
        F.coalesce("title", F.lit("")).alias("title"), "saved", text.alias("value"),
    )
    last = named.groupBy("day", "title").agg(F.max(F.struct("saved", "value")).getField("value").alias("value"))
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "title").text(folder)


def file_name(day: Column, title: Column) -> Column:
    return F.concat(day, F.lit(NAME_SEPARATOR), title, F.lit(SUFFIX))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, day, title, text) of all entries. Sorted by ``file_name`` from the last, the newest come first."""
    found = spark.read.schema(SCHEMA).text(folder, wholetext=True)
    title = F.coalesce("title", F.lit(""))  # an empty partition value is read as null
    # the writer ends a file with one line break of its own
    return found.select(file_name(F.col("day"), title).alias("file_name"), "day", title.alias("title"), F.regexp_replace("value", "\\n\\z", "").alias("text"))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest entry: its name comes from the partitions, and only its folder is read."""
    files = spark.read.schema(SCHEMA).text(folder, wholetext=True)
    title = F.coalesce("title", F.lit(""))
    newest = files.select("day", title.alias("title")).orderBy(F.desc(file_name(F.col("day"), title))).limit(1)
    return stored(spark, folder).join(F.broadcast(newest), ["day", "title"]).select("file_name", "day", "title", "text")
